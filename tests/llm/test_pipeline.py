import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm.common import shared_dir
from gridloom.llm.queries import tokenizer_path
from tests.conftest import SF
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_dedup import brute as deduplicated
from tests.llm.test_near_dup import brute as grouped


def test_stages_against_plain_versions(spark):
    shared_dir(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "benchmark decontamination", "best-fit packing"]
    clean = steps["toxicity"](spark, docs, SF).checkpoint()
    assert clean.schema == docs.schema
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    gone = {r.doc_id for r in docs.collect()} - kept
    assert gone and all(labels.get(i, 1) == 1 for i in gone)

    lines = steps["line dedup"](spark, clean, SF).checkpoint()
    expected = deduplicated({(r.doc_id, r.text) for r in clean.collect()})
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for (i, _), t in expected.items()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    one = steps["near duplicates"](spark, lines, SF).checkpoint()
    groups = grouped([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == [i for i, n, c in groups if i == c]

    cut = steps["benchmark decontamination"](spark, one, SF).checkpoint()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert cut.count() == one.count() and cut.schema == docs.schema
    assert not any(r[-1] for r in contaminated([(r.doc_id, r.text) for r in cut.collect()], bench))

    packed = steps["best-fit packing"](spark, cut, SF)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in cut.collect()]
    pieces = [(i, k // 4096, k, ids[k : k + 4096]) for i, ids in expected for k in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()) == sorted((i, p, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, p, s, x in pieces)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

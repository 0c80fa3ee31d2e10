import re
from collections import Counter, defaultdict
from math import sqrt

from gridloom.llm.url_filter import RULES, Settings, filter_urls
from tests.conftest import SF


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fitting = []
    for action, text in RULES:
        own, _, below = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + below):
            fitting.append((len(text), text, action))
    return max(fitting)[1:] if fitting else (None, None)


def classed(path, depth):
    parts = [x for x in path.split("/") if x]

    def kind(x):
        if re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", x):
            return "<d>"
        if re.fullmatch(r"\d+(\.[A-Za-z0-9]{1,5})?", x):
            return re.sub(r"^\d+", "<n>", x)
        if re.fullmatch(r"(?=.*\d)[0-9a-fA-F-]{8,}", x) or len(x) > 40:
            return "<x>"
        return x

    found = [kind(x) for x in parts]
    return tuple(found) if len(found) <= depth else (*found[: depth - 1], "/".join(found[depth - 1 :]))


def brute(rows, s=Settings()):
    parsed = [(i, *parse(u)) for i, u in rows]
    labelled = [(i, h, p, *rule_of(h, p), classed(p, s.depth)) for i, h, p in parsed]
    counts = defaultdict(lambda: [0, 0, 0])
    for _, h, _, _, action, segs in labelled:
        c = counts[h, segs]
        c[0] += 1
        c[1] += action == "allow"
        c[2] += action == "block"
    template = {k: () for k in counts}
    for level in range(max((len(k[1]) for k in counts), default=0)):
        forms, sums = defaultdict(Counter), defaultdict(lambda: [0, 0, 0])
        for (h, segs), c in counts.items():
            if len(segs) > level:
                child = (h, template[h, segs], segs[level])
                forms[child]["/".join(x if x[0] == "<" else "w" for x in segs[level + 1 :])] += c[0]
                for k in range(3):
                    sums[child][k] += c[k]
        form = {c: max((n, f) for f, n in x.items())[1] for c, x in forms.items()}
        steps = {}
        for child, (n, good, bad) in sums.items():
            siblings = [c for c in sums if c[:2] == child[:2]]
            peers = [c for c in siblings if form[c] == form[child]]
            labels = good + bad

            def similar(among):
                g, b = sum(sums[c][1] for c in among), sum(sums[c][2] for c in among)
                pooled = b / max(g + b, 1)
                return labels == 0 or abs(bad / max(labels, 1) - pooled) < s.z * sqrt(max(pooled * (1 - pooled), 0.05) / max(labels, 1))

            total = sum(sums[c][0] for c in siblings)
            rare = [c for c in siblings if len(siblings) > s.fan_out and sums[c][0] < s.share * total]
            steps[child] = "*" if (child in rare and similar(rare)) or (len(peers) > 1 and similar(peers)) else child[2]
        template = {k: t + ((steps[k[0], t, k[1][level]],) if len(k[1]) > level else ()) for k, t in template.items()}
    keys = {k: [("site", ".".join(k[0].split(".")[-2:])), ("host", k[0])] + [(n, k[0], template[k][:n]) for n in range(1, len(template[k]) + 1)] for k in counts}
    good, bad = Counter(), Counter()
    for k, c in counts.items():
        for x in keys[k]:
            good[x] += c[1]
            bad[x] += c[2]
    g, b = (sum(c[k] for c in counts.values()) for k in (1, 2))
    out = []
    for i, h, p, rule, action, segs in labelled:
        share = (b + 1) / (g + b + 2) if g + b else 0.0
        for x in keys[h, segs]:
            share = (bad[x] + s.strength * share) / (good[x] + bad[x] + s.strength)
        out.append((i, h, p, rule, action or ("block" if share >= s.reject_from else "allow"), "/" + "/".join(template[h, segs]), round(share, 9)))
    return sorted(out, key=str)


def same(found, expected):
    for a, b in zip(sorted((tuple(r) for r in found), key=str), expected, strict=True):
        assert a[:6] == b[:6] and abs(a[6] - b[6]) < 1e-6, (a, b)


def test_real_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    same(filter_urls(pages).collect(), brute([(r.page_id, r.url) for r in pages.collect()]))


def test_many_shapes(spark):
    rows = [(k, f"http://Shop.example.com/{'fr' if k % 2 else 'de'}/item-{k}/2024-01-0{k % 9}?q=1") for k in range(90)]
    rows += [(100 + k, f"https://a.b.example.net/{c}/x{k}/deep/er/and/deeper") for k, c in enumerate("abcabcabca")]
    rows += [(200 + k, f"https://example.org/{c}/{k}") for k, c in enumerate(["es", "en", "en", "fr"] * 5)]
    rows += [(300, None), (301, ""), (302, "no scheme/x"), (303, "x://"), (304, "x://Org/"), (305, "x://notorg/a"), (306, "x://org?/"), (307, "a://h#/de/"), (308, "x://com//fr/"), (308, "x://com/fr/"), (None, "x://ÉX.com/de/1.html")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = filter_urls(pages).collect()
    same(found, brute(rows))
    by = {r.page_id: r for r in found}
    assert by[304].rule == "org/" and by[305].rule is None and by[306].rule is None and by[300].host == by[300].path == ""
    assert by[200].rule == "example.org/es/" and by[201].rule == "example.org/en/1" or by[201].rule == "org/"


def test_deep_paths_and_rare_children(spark):
    """Sections at the sixth level have templates; a rare child that is blocked stays apart from those that are allowed;
    segments from the last level on are one."""
    rows = [(k, f"http://com/fr/a/b/c/{'bad' if k % 2 else 'good'}/{k}/x") for k in range(40)]
    rows += [(100 + k, f"http://s{k % 2}.com/{'de' if k < 20 else 'fr'}/k{k}/p") for k in range(200)]
    rows += [(400, "http://deep.net/" + "/".join("abcdefg")), (401, "http://deep.net/" + "/".join("abcdefh"))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for settings in (Settings(), Settings(depth=3)):
        same(filter_urls(pages, settings=settings).collect(), brute(rows, settings))
    by = {r.page_id: r.template for r in filter_urls(pages).collect()}
    assert by[0] == "/fr/a/b/c/*/<n>/x" and by[400].count("/") == 7


def test_without_labels_all_is_allowed(spark):
    rows = [(1, "http://a.net/x"), (2, "http://b.net/"), (3, None)]
    assert {r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()} == {"allow"}


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, host int")).count() == 0

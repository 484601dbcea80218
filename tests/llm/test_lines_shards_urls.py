import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkdoc.llm import line_dedup, sharding, url_filter

from .helpers import ASCII_LOWER, documents

SPACE = " \t\n\x0b\x0c\r"


def dropped(rows, least=10):
    key = lambda x: x.strip(SPACE).translate(ASCII_LOWER)
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    docs = Counter(k for _, ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for d, ls in lines:
        kept = [x for x in ls if not (key(x) and docs[key(x)] >= least)]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINES = [(i, f"  Common Line\t\nown {i}\n\nÉcole\x0b\nrare {i % 3}\ncommon line" + "\nmid" * (i % 4)) for i in range(12)] + [(50, None), (51, ""), (52, "\n"), (None, "common line"), (7, "common line\nx"), (7, "common line\nx"), (60, "\n".join(f"l{i}" for i in range(30000)) + "\ncommon line\nend"), (61, "école")]


def test_line_dedup_equals_brute_force(spark):
    got = line_dedup.line_dedup(documents(spark, LINES, extra=True)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == dropped(LINES)
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


def test_first_occurrences_stay(spark):
    rows = [(3, "b\na\nA"), (1, "x\na"), (2, "a\nb\nc"), (2, "a\nb\nc")]
    got = {(r.doc_id, r.kept_text) for r in line_dedup.line_dedup(documents(spark, rows), min_docs=2, keep="first").collect()}
    assert (1, "x\na") in got and (3, "") in got
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(documents(spark, rows), keep="last")


def test_run_lengths(spark):
    for n, gone in [(1, []), (1, [0]), (5, [0, 1, 4]), (6, [2]), (4, [0, 1, 2, 3]), (7, [1, 3, 5])]:
        runs = spark.range(1).select(line_dedup.keep_runs(F.lit(n), F.array(*map(F.lit, gone)).cast("array<int>"))).first()[0]
        assert [i for r in runs for i in range(r["first"], r["first"] + r["length"])] == [i for i in range(n) if i not in gone]


def draw(key, node):
    h = xxhash.xxh64(node.name.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / node.weight


def shard(key, node):
    while node.children:
        node = min(node.children, key=lambda c: draw(key, c)) if len(node.children) > 1 else node.children[0]
    return node.shard


def test_sharding_equals_the_plain_descent(spark):
    rows = [(i, f"text {i % 50}") for i in range(900)] + [(None, None), (5, "text 5"), (5, ""), (-1, "é")]
    got = sharding.sharded(documents(spark, rows, extra=True), sharding.layout(8)).collect()
    tree = sharding.layout(8)
    texts = Counter()
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        raw = (r.text or "").encode()
        assert r.shard == shard(key, tree) and r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert r.grown_shard == shard(key, sharding.grown(tree)) and r.grown_shard in (r.shard, 8)
        texts[r.shard] += 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(texts[s])) and 70 < texts[s] < 160
    assert 60 < sum(r.grown_shard == 8 for r in got) < 150
    assert sharding.sharded(documents(spark, []), tree).count() == 0
    assert struct.calcsize("q") == 8


def test_weight_changes_move_keys_of_that_subtree_only():
    a, b = sharding.layout(8), sharding.layout(8)
    heavy = sharding.Node("shard5", shard=5, own_weight=3.0)
    rack = b.children[1].children[0]
    b = sharding.Node("root", (b.children[0], sharding.Node("region1", (sharding.Node(rack.name, (rack.children[0], heavy)), b.children[1].children[1]))))
    for i in range(3000):
        was, now = shard(str(i), a), shard(str(i), b)
        assert was == now or now in (4, 5, 6, 7)
    with pytest.raises(ValueError):
        sharding.layout(0)


URLS = ["http://WWW.Example.org/es/1?x=1", "https://example.org/en/17", "https://example.org/en/2#t", "http://a.b.com/fr/9.html", "http://b.com/de/1", "http://x.net", "http://x.net?q", "ftp://y.org/z://w", "nothing", None, "", "://h/p", "http://Éa.com/FR/1", "http://notexample.org/es/1"]


def plain(url):
    rest = (url or "").partition("://")[2]
    for c in "?#":
        rest = rest.split(c)[0]
    host, slash, path = rest.partition("/")
    return host.translate(ASCII_LOWER), slash + path


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, labels).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain(u)
        fits = [(len(t), t, v) for v, t in url_filter.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u
    assert url_filter.url_verdicts(pages.limit(0), labels).count() == 0


def test_templates_generalise_and_block(spark):
    rows = [(i, f"http://h.net/item/{i}.html") for i in range(300)] + [(1000 + i, f"http://h.net/spam/w{i:c}x{i}/buy") for i in range(97, 197)] + [(2000 + i, f"http://h.net/about/{'abc'[i % 3]}") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1097 + i, 0) for i in range(0, 100, 2)] + [(2000 + i, 1) for i in range(30)], "doc_id long, quality int")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, labels).collect()}
    assert got[4].template == "/item/{n}.html" and got[4].verdict == "allow" and got[2000].template == "/about/{~a}"
    assert all(got[i].verdict == "block" and got[i].template.startswith("/spam/") for i in range(1097, 1197))
    wide = [r for r in got.values() if r.template == "/spam/{*}/buy"]
    assert len(wide) == 100


def test_frequent_sections_stay_beside_many_rare_ones(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(300)] + [(1000 + i, f"http://h.net/odd{chr(97 + i)}/{i}") for i in range(26)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, labels).collect()}
    assert {r.template for r in got.values()} == {"/spam/{n}", "/news/{n}", "/{*}/{n}"}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(300))


def plain_templates(rows, poor_of, policy):
    """{page_id: (template, purity, blocked)} by loops over a host's paths. Segments are taken as they are or as {n}."""
    known = [p for i, _ in rows if (p := poor_of.get(i)) is not None]
    prior = sum(known) / len(known) if known else 0.0
    at = {}
    for i, url in rows:
        host, path = plain(url)
        parts = path.split("/", policy.depth)
        at[i] = (host, [re.sub(r"^\d+$", "{n}", x) for x in parts], "")
    for level in range(1, max(len(x[1]) for x in at.values())):
        nodes = {}
        for i, (host, parts, template) in at.items():
            if len(parts) > level:
                rest = "/".join(x if "{" in x else "{w}" for x in parts[level + 1 :])
                c = nodes.setdefault((host, template), {}).setdefault(parts[level], [0, 0, 0, Counter()])
                c[0] += 1
                c[1] += poor_of.get(i) is not None
                c[2] += poor_of.get(i) or 0
                c[3][rest] += 1
        names = {}
        for node, children in nodes.items():
            kept, of = {}, {}
            for child, (n, labelled, poor, shapes) in children.items():
                of[child] = "{*}" if len(children) > policy.fan_out and n < policy.pages and labelled < policy.labels else child
                k = kept.setdefault(of[child], [0, 0, []])
                k[0] += labelled
                k[1] += poor
                k[2].append((n, max((v, x) for x, v in shapes.items())[1]))
            by = {}
            for child, (labelled, poor, shapes) in kept.items():
                share = (poor + policy.strength * prior) / (labelled + policy.strength)
                by.setdefault(max(shapes)[1], []).append((math.asin(math.sqrt(share)), child, 0.25 / (labelled + policy.strength)))
            for items in by.values():
                items.sort()
                classes = {}
                for j, (y, child, e2) in enumerate(items):
                    if j == 0 or y - items[j - 1][0] > policy.z * math.sqrt(e2 + items[j - 1][2]):
                        begin = (j, y)
                    classes.setdefault((begin[0], math.floor((y - begin[1]) / policy.span)), []).append(child)
                for members in classes.values():
                    for child in members:
                        names[node, child] = child if len(members) == 1 else "{~" + min(members) + "}"
            for child, to in of.items():
                names[node, child] = names[node, to]
        at = {i: (h, x, t + "/" + names[(h, t), x[level]] if len(x) > level else t) for i, (h, x, t) in at.items()}
    counts = {}
    for i, (host, _, template) in at.items():
        c = counts.setdefault((host, template), [0, 0])
        c[0] += poor_of.get(i) is not None
        c[1] += poor_of.get(i) or 0
    share = {k: (poor + policy.strength * prior) / (n + policy.strength) for k, (n, poor) in counts.items()}
    return {i: (t, 1 - share[h, t], share[h, t] > policy.reject) for i, (h, _, t) in at.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_plain_loops(spark, seed):
    r = random.Random(seed)
    hosts = [f"{x}.net" for x in "abc"]
    words = [f"s{x}" for x in "abcdefghijkl"]
    chance = {w: r.choice([0.02, 0.05, 0.5, 0.9, 0.97]) for w in words}
    rows, labels = [], []
    for i in range(1500):
        path = [r.choice(words) for _ in range(r.choice([0, 1, 1, 2, 3]))] + r.choice([[], ["7"], [str(r.randrange(100))]])
        rows.append((i, f"http://{r.choice(hosts)}/" + "/".join(path)))
        if r.random() < 0.4:
            labels.append((i, int(r.random() >= max((chance.get(x, 0) for x in path), default=0))))
    rows += [(2000, "http://a.net/" + "/".join(["deep"] * 2000)), (2001, "http://a.net/" + "x" * 50_000), (2002, rows[0][1]), (2003, None), (2004, "http://a.net")]
    policy = url_filter.Policy(fan_out=6, pages=60, labels=12)
    want = plain_templates(rows, {i: 1 - q for i, q in labels}, policy)
    frames = spark.createDataFrame([*rows, (2003, None)], "page_id long, url string"), spark.createDataFrame([*labels, *labels[:5]], "doc_id long, quality int")
    got = url_filter.url_verdicts(*frames, rules=(), policy=policy).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        template, purity, blocked = want[x.page_id]
        assert (x.template, x.verdict) == (template, "block" if blocked else "allow") and abs(x.purity - purity) < 1e-9, x
    assert sum(x.verdict == "block" for x in got) > 20


def test_sparse_branches_merge_and_small_steps_do_not_chain(spark):
    rows = [(100 * u + i, f"http://h.net/u{chr(97 + u)}/{i}") for u in range(20) for i in range(8)]
    rows += [(10_000 + 100 * u + i, f"http://g.net/v{chr(97 + u)}/{i}") for u in range(20) for i in range(100)]
    labels = [(i, 0) for i, u in rows if "h.net" in u] + [(10_000 + 100 * u + i, int(i >= 5 * u)) for u in range(20) for i in range(100)] + [(50_000 + i, 1) for i in range(2000)]
    rows += [(50_000 + i, f"http://clean.net/p/{i}") for i in range(2000)]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"), rules=()).collect()}
    assert {got[i].verdict for i, u in rows if "h.net" in u} == {"block"} and {got[i].template for i, u in rows if "h.net" in u} == {"/{~ua}/{n}"}
    assert {got[10_000 + i].verdict for i in range(300)} == {"allow"} and {got[10_000 + 1800 + i].verdict for i in range(200)} == {"block"}
    assert len({got[10_000 + 100 * u].template for u in range(20)}) > 2

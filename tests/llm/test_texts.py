import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkdoc.llm import chat, decontaminate, passages, pieces, quality, secret_scan, textkit

from sparkdoc.llm.common import session_conf

from .helpers import documents, shingle_set, words

try:
    import public_tokenizers as P
except ImportError:
    P = None
tokenizers = pytest.mark.skipif(P is None, reason="no tokenizer files")
ODD = ["", None, " ", "a", "  a  b   ", "▁", "a▁b ▁▁ x", "\n\n a\t b", "日本語 テスト 🎉🎉", "<s> </s> <0x41>", "x" * 3000, "\x00a\x00", "é́ x"]


def sample(seed=1, n=200):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(["a", " ", "  ", "▁", "é", "🎉", "\n", "th", "ing", "日", "w "]) for _ in range(r.randint(0, 60))) for _ in range(n)]


# ---- pieces
@tokenizers
def test_pieces_equal_the_library_and_spans_cover(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = sample()
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)], extra=True)
    got = {r.doc_id: r for r in pieces.encoded_digests(docs, P.path("piece_bpe_32k.model")).collect()}
    full = {r.doc_id: r for r in pieces.encoded(docs, P.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        said = library.decode(ids)
        assert full[i].ids == ids and got[i].n_tokens == len(ids) and full[i].decoded == library.decode(ids[:-1])
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
        found = library.encode(t or "", return_type="proto").pieces
        assert len(full[i].starts) == len(ids) - 1
        if t and "\x00" not in t:
            assert full[i].starts[0] == 0 and full[i].ends[-1] == len(t.encode())
            for k, p in enumerate(found):
                if "<0x" not in p.piece:
                    lead = t.encode()[full[i].starts[k] : full[i].ends[k]].decode()
                    assert lead == p.surface, (t, k)
    assert pieces.encoded_digests(documents(spark, []), P.path("piece_bpe_32k.model")).count() == 0


@tokenizers
def test_digests_come_from_aligned_and_decoded_pieces(monkeypatch):
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        encoder = pieces.Encoder(f.read())
    texts = [*sample(7, 300), "a\nb", "\n", " \n", "a \n b\n\nc", "  \n", "x\n▁y ▁\n z", "a" * 500 + "\n" + "b c" * 300, "long words " * 20_000, "same", "same"]
    projected, decoded = [], []
    batch, decode = encoder.batch, encoder.decode
    monkeypatch.setattr(encoder, "batch", lambda x: projected.append(len(x)) or batch(x))
    monkeypatch.setattr(encoder, "decode", lambda x: decoded.extend(x) or decode(x))
    got = pieces._digests(pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"]), encoder)
    assert projected == [len(texts)] and len(decoded) == len(texts)
    assert got.column(3).to_pylist() == [hashlib.sha256(x.encode()).hexdigest() for x in decode(decoded)]
    assert decoded == [encoder.library.encode(x or "") for x in texts]
    # a batch's spans are those of its texts one by one
    ids, starts, ends = batch(pa.array(texts, pa.string()))
    alone = [encoder.spans(x) for x in texts]
    assert [x.tolist() for x in ids] == [x[0] for x in alone]
    assert (np.stack([starts, ends], 1) == np.concatenate([x[1] for x in alone])).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    for kw in ({}, {"add_dummy_prefix": True}, {"remove_extra_whitespaces": True}):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **kw)
        proto = pb.ModelProto()
        proto.ParseFromString(library.serialized_model_proto())
        own = pieces.Normalizer(proto.normalizer_spec)
        for t in ["Ｆｕｌｌ ｗｉｄｔｈ  ①②", "ﬁne ﾊﾞｲﾄ", " a  b ", "é́", "", "  ", "Straße ㌔ x"]:
            normal, align = own(t)
            assert normal.decode().replace("▁", " ") == library.normalize(t).replace("▁", " "), (rule, kw, t)
            assert len(align) == len(normal) + 1 and (np.diff(align) >= 0).all()


# ---- quality
def counts(text):
    text = text or ""
    w = words(text, False)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(cover)]


def test_statistics_equal_brute_force(monkeypatch):
    monkeypatch.setattr(textkit, "PIECE", 64)
    texts = sample(3) + ["a\na\na", "a b c a b c", "\na\n\na", " a\na ", "\x0b\n\x0b", "a\n", "a\na", "x\n", "x", "# $ |\n# $ |"]
    base, features = quality.statistics(pa.array(texts, pa.string()))
    assert base.tolist() == [counts(t) for t in texts] and np.isfinite(features).all()


def test_trees_learn_and_keep_their_constraints():
    r = np.random.default_rng(0)
    x = r.random((3000, 4))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2) ^ (r.random(3000) < 0.02)).astype(float)
    trees = quality.fit(x[:2000], y[:2000], {0: -1})
    assert ((trees.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.94
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(trees.score(grid).reshape(50, 40), axis=1) <= 1e-9).all()
    plain = np.array([sum(_walk(trees, root, row) for root in trees.roots) + trees.bias for row in x[:100]])
    assert np.allclose(plain, trees.score(x[:100]))


def _walk(t, at, row):
    while t.left[at] != at:
        at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
    return t.value[at]


def test_judged(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(["the", "of", "house", "river", "went", "stone"]) + r.choice("abcdefgh") for _ in range(80)) for _ in range(60)]
    poor = [" ".join(r.choice(["###", "$$$", "win%%%", "x|"]) + r.choice("abcdefgh") for _ in range(80)) for _ in range(60)]
    rows = list(enumerate(good + poor + ["short", None, ""]))
    docs = documents(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.judged(docs, quality.train(docs, labels)).collect()}
    assert all(out[i].kept == (i < 60) for i in range(120)) and not any(out[i].kept for i in (120, 121, 122)) and out[121].base_failed
    assert quality.train(docs, labels.limit(0)) is None and quality.judged(docs, None).where("kept").count() == 120
    assert quality.judged(docs.limit(0), None).count() == 0


# ---- secrets
def spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_scans(spark):
    r = random.Random(5)
    key = lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows = [(i, f"é words of text here {x} and more words, internationalisation everywhere {r.randrange(10**15, 10**16)}") for i, x in enumerate([f"Password = '{hexes(18)}'" for _ in range(40)] + [key() for _ in range(40)] + [hexes(40) for _ in range(40)] + [f"x {hexes(18)} y" for _ in range(20)] + ["ſecret=abcdefgh", "token: ab password=secret12", "AKIAshort", "tokenAKIA" + "A" * 30] + ["plain words"] * 20)] + [(900, None), (901, "")]
    docs = documents(spark, rows, extra=True)
    got = {x.doc_id: x for x in secret_scan.scanned(docs, secret_scan.train(docs)).collect()}
    for i, t in rows:
        want = spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_assign == want.count("assign") and got[i].n_hex == want.count("hex") and got[i].n_access == want.count("access")
        assert {s for s in got[i].spans.split(",") if not s.startswith("learned")} == set(want.split(","))  or not want
    assert sum("learned" in got[i].spans for i in range(120, 140)) >= 16  # bare keys of the assigned format
    assert sum("learned" in x.spans for i, x in got.items() if i >= 144) == 0
    # short and glued credentials of a known format, in urls and beside other marks; and texts of any length, repeated
    short = lambda: "".join(r.choices("BCDFGHJKLMNPQRSTVWXZ", k=4)) + "".join(r.choices("0123456789", k=7))
    keys = [short() for _ in range(12)]
    long = "é" + "lorem ipsum " * 30_000 + keys[3] + " dolor" * 1_000 + " " + "x" * 50_000
    tried = [f"see http://host.example/a/{keys[0]}/b?c", f"name={keys[1]} and", f"plain {keys[2]}.", long, long, *["a plain text of words"] * 3, None]
    labelled = [(i, f"token={short()} among plain words like internationalisation and host.example/path") for i in range(200)]
    more = secret_scan.train(documents(spark, labelled))
    found = {}
    for x in secret_scan.scanned(documents(spark, list(enumerate(tried))), more).collect():
        found[x.doc_id] = [tried[x.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in x.spans.split(",") if s.startswith("learned")]
    assert found == {0: [keys[0]], 1: [keys[1]], 2: [keys[2]], 3: [keys[3]], 4: [keys[3]], 5: [], 6: [], 7: [], 8: []}
    assert secret_scan.scanned(docs.limit(0), secret_scan.train(docs.limit(0))).count() == 0


def test_automaton_prefers_its_format():
    r = random.Random(1)
    make = lambda: "ab-" + "".join(r.choices("0123456789", k=10))
    a = secret_scan.infer([make() for _ in range(300)])
    assert a.score(make()) > -60 > a.score("zz-" + "q" * 10) and len(a.goto) < 40
    # spans scored together have the scores that each has alone, however long
    words = [make() + "Z" * r.randrange(40) for _ in range(50)] + ["q" * 3000, "x"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    together = a.scores(secret_scan._CLASS[data], stop - [len(w) for w in words], stop)

    def plain(w):
        s, total = 0, 0.0
        for ch in w:
            c = 0 if ch.isdigit() else 1 if ch in "abcdef" else 2 if ch.islower() else 3 if ch.isupper() else 4
            total += a.logp[s, c]
            s = a.goto[s, c]
        return total + a.end[s]

    assert np.allclose(together, [plain(w) for w in words])


# ---- decontamination
def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([20, 20, 35, 60, 60, 90, 4, 15])] + [(8, None), (9, ""), (10, items_text := " ".join(["same word pair"] * 12))]
    rows = []
    for i in range(160):
        w = text(r.choice([0, 3, 50, 200]))
        if i % 2:
            p = words(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if p:
                    p[r.randrange(len(p))] = r.choice(vocabulary)
            w[len(w) // 2 : len(w) // 2] = [x.upper() for x in p]
        rows.append((i, "  ".join(w)))
    rows += [(500, None), (501, items_text), (None, items[0][1]), (7, items[3][1]), (7, items[3][1])]

    def has(doc, item):
        w, p = words(doc), words(item)
        if not p:
            return False
        k = min(5, len(p))
        c = Counter(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
        m = sum(c.values())
        for s in range(len(w) - len(p) + 1):
            o = Counter(tuple(w[j : j + k]) for j in range(s, s + m))
            n = sum((o & c).values())
            if n >= 0.8 * (2 * m - n) - 1e-9:
                return True
        return False

    want = sorted(((d, i) for d, t in rows for i, x in items if has(t, x)), key=str)
    docs, bench = documents(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 100):
        got = sorted(((x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, block_words=block).collect()), key=str)
        assert got == want and want
    clean = decontaminate.clean(docs, bench)
    assert sorted((x.doc_id for x in clean.collect()), key=str) == sorted((d for d, t in rows if not any(has(t, x) for _, x in items)), key=str) and clean.columns == docs.columns
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_shortened_items_and_repeated_shingles(spark):
    items = [[f"d{i}w{j}" for j in range(n)] for i, n in enumerate([64, 40, 84])]
    # 80 shingles once and one ten times: a ruler in the middle
    ruled = [[f"r{i}a{j}" for j in range(40)] + [f"-{i}-"] * 14 + [f"r{i}b{j}" for j in range(40)] for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate([items[0][:30] + items[0][31:], items[0][:-1], items[0][6:], items[1][1:], items[1][:20] + items[1][24:], items[2][:20] + items[2][40:]])]
    assert [len(t.split()) for _, t in rows] == [63, 63, 58, 39, 36, 64]
    rows += [(100 + i, " ".join(w[:40] + [f"n{i}x{j}" for j in range(4)] + w[44:])) for i, w in enumerate(ruled)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(100 + i, " ".join(w)) for i, w in enumerate(ruled)], "item_id long, text string")

    def jaccard(a, b):
        x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a.split(), b.split()))
        n = sum((x & y).values())
        return n / (sum(x.values()) + sum(y.values()) - n)

    said = {x.item_id: x.text for x in bench.collect()}
    want = sorted((d, i) for d, t in rows for i, x in said.items() if jaccard(t, x) >= 0.8)
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.leaks(documents(spark, rows), bench).collect()) == want and len(want) > 40
    assert sorted(x.doc_id for x in decontaminate.clean(documents(spark, rows), bench).collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})


# ---- passages
def cartesian(v, least):
    out = []
    for c in range(len(v)):
        a = b = c
        while a > 0 and v[a - 1] > v[c]:
            a -= 1
        while b + 1 < len(v) and v[b + 1] >= v[c]:
            b += 1
        if b - a + 1 >= least:
            out.append((int(v[c]), a, c, b))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 5, 46])
def test_windows_are_the_cartesian_trees_nodes_joined_on_their_intervals(least):
    r = np.random.default_rng(least)
    texts = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 46, 45, 120, 1)]
    tokens, text = np.concatenate(texts), np.repeat(np.arange(5), [len(t) for t in texts])
    base = np.cumsum([0, *map(len, texts)])
    for family in range(passages.FAMILIES):
        want = []
        for t, b in zip(texts, base, strict=False):
            # a node's runs begin within its subtree, so that they hold it
            trees = [[(c, max(a, c - least + 1), min(c, e - least + 1)) for _, a, c, e in cartesian(textkit.mix(t * passages._SEEDS[h]), least)] for h in (2 * family, 2 * family + 1)]
            want += [(b + max(a, x), b + c, b + min(e, y) + least - 1) for c, a, e in trees[0] for _, x, y in trees[1] if max(a, x) <= min(e, y)]
        _, l, c, r_ = passages.joint_windows(tokens, text, family, least)
        assert sorted(zip(l.tolist(), c.tolist(), r_.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_members_are_those_of_whole_groups(size):
    """Groups that go over batches, with copies of rows, against a plain grouping."""
    r = np.random.default_rng(3)
    rows = [(int(v) * 4 + int(f), int(t) ^ int(passages._ORDER[f]), int(p) * 46 * 46 + 46 * 3 + 5) for v, f, t, p in zip(r.integers(0, 40, 600), r.integers(0, 3, 600), r.integers(0, 6, 600), r.integers(0, 4, 600), strict=True)]
    rows = sorted(rows + rows[:100] + [(801, 7 ^ int(passages._ORDER[1]), 46 * 46 * i) for i in range(9)])
    table = np.array(rows)
    batches = [pa.record_batch([pa.array(table[i : i + size, j]) for j in range(3)], ["value", "rank", "place"]) for i in range(0, len(table), size)]
    got = sorted(x for b in passages._members(batches, 46) for x in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
    want = []
    for v in {x[0] for x in rows}:
        group = sorted({x for x in rows if x[0] == v})
        if len({x[1] for x in group}) > 1:
            turn, (_, cr, cp) = int(passages._ORDER[v & 3]), group[0]
            for _, rank, place in group:
                win = len(group) > 2 and v & 3 == 0
                c, cc = place // 46**2, cp // 46**2
                if rank != cr or (win and c != cc):
                    want.append((rank ^ turn, cr ^ turn, c - cc, c - place % 46**2 // 46, c + place % 46, win))
    assert got == sorted(want)


def test_periodic_texts_have_few_windows():
    t = np.tile(np.random.default_rng(1).integers(0, 1 << 63, 3, dtype=np.uint64), 5000)
    name, *_ = passages.joint_windows(t, np.zeros(len(t), np.int64), 0, 46)
    assert len(name) <= 6


def test_exact_repeats_are_found(spark):
    r = random.Random(9)
    vocabulary = [f"u{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    line = text(20)
    shared = [text(n) for n in (50, 55, 80, 200)]
    rows = []
    for i in range(60):
        w = text(r.choice([40, 150, 400]))
        at = r.randrange(len(w))
        w[at:at] = line
        if i % 2:
            at = r.randrange(len(w))
            w[at:at] = shared[i % 4] if i % 8 < 6 else shared[0]
        rows.append((i, " ".join(w)))
    near = text(120)
    rows += [(100, " ".join(near)), (101, " ".join([*near[:60], "changed", *near[61:]])), (102, None), (103, ""), (104, "few words"), (105, " ".join(near)), (105, " ".join(near)), (None, " ".join(near))]

    def runs(a, b, n=50):
        x = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
        return any(tuple(b[i : i + n]) in x for i in range(len(b) - n + 1))

    got = passages.repeated_passages(documents(spark, rows, extra=True)).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = {}
    for d, t in rows:
        by.setdefault(d, words(t))
    for x in got:
        parent[find(x.doc_id)] = find(x.rep_doc_id)
        a, b = by[x.doc_id][x.start_word : x.start_word + x.n_words], by[x.rep_doc_id][x.rep_start_word : x.rep_start_word + x.rep_n_words]
        s, t = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert x.n_words >= 50 and len(s & t) / len(s | t) >= 0.75
    for i, (d, t) in enumerate(rows):
        for e, u in rows[:i]:
            if d != e and runs(words(t), words(u)):
                assert find(d) == find(e), (d, e)
    flagged = {x.doc_id for x in got} | {x.rep_doc_id for x in got}
    assert flagged == {d for i, (d, t) in enumerate(rows) for j, (e, u) in enumerate(rows) if i != j and d != e and runs(words(t), words(u))} | {101}
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def test_exact_repeats_are_found_beside_a_third_text(spark):
    """A = X Y, B = X Y Z, C = Y Z in every order of ids, and a passage at a center's second place: each repeat has a pair that holds it."""
    r = random.Random(21)
    text = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for g in range(60):
        x, y, z, line = text(60), text(r.choice([12, 20, 30])), text(r.choice([25, 40])), text(12)
        made = [x + y, text(20) + x + y + z + text(20), text(20) + y + z + text(20)]
        shared = text(20) + line + text(20)
        made += [line + text(60) + shared, text(30) + shared + text(30), text(20) + line + text(40)]
        rows += [(10 * g + i, " ".join(w)) for i, w in enumerate(r.sample(made, len(made)))]
    got = passages.repeated_passages(documents(spark, rows)).collect()
    cover = {}
    for p in got:
        for d, a, n in ((p.doc_id, p.start_word, p.n_words), (p.rep_doc_id, p.rep_start_word, p.rep_n_words)):
            cover.setdefault(d, []).append((a, a + n))
    runs = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    lost = [(d, i) for places in runs.values() if len({d for d, _ in places}) > 1 for d, i in places if not any(a <= i and i + 50 <= b for a, b in cover.get(d, ()))]
    assert not lost, lost[:5]


def test_near_repeats_recall(spark):
    """Fifty words with the middle one changed (similarity 0.80), alone and beside texts that have a part of them: over nine of ten are found, nothing else."""
    r = random.Random(22)
    text = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for g in range(400):
        p = text(50)
        q = [*p[:25], "changed", *p[26:]]
        made = [text(15) + p + text(15), text(15) + q + text(15)]
        if g % 2:  # parts of the passage that are too short for a pair
            made += [text(30) + p[a : a + 18] + text(30) for a in (0, 7, 26, 32)]
        rows += [(10 * g + i, " ".join(w)) for i, w in enumerate(made)]
    got = {frozenset((x.doc_id, x.rep_doc_id)) for x in passages.repeated_passages(documents(spark, rows)).collect()}
    want = {frozenset((10 * g, 10 * g + 1)) for g in range(400)}
    assert got <= want and len(got) >= 0.93 * len(want)


def test_near_repeats_are_found_beside_many_third_texts(spark):
    """Two near texts whose groups have other texts as centers: parts too short for a pair, or a chain of near texts of which only neighbours link."""
    r = random.Random(23)
    text = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    rows, parent, spans, want = [], {}, {}, []

    def add(passage):
        head = text(15)
        rows.append((len(rows), " ".join(head + passage + text(15))))
        return len(rows) - 1

    changed = lambda p, *at: [f"x{r.randrange(10**9)}" if i in at else w for i, w in enumerate(p)]
    for g in range(60):
        p = text(80)
        made = [add(x) for x in r.sample([p, changed(p, 40), *(text(20) + p[a : a + 40] + text(20) for a in [0, 5, 10, 15, 20, 25, 30, 35, 40] * 3)], 29)]
        pair = [i for i in made if sum(w in set(p) for w in rows[i][1].split()) > 60]
        want.append(tuple(pair))
        chain = [p := text(60)]
        for at in (5, 12, 20, 28, 36, 44, 52, 56):
            chain.append(p := changed(p, at))
        made = [add(x) for x in chain]
        want += list(zip(made, made[1:], strict=False))
    r.shuffle(rows)
    got = passages.repeated_passages(documents(spark, rows)).collect()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x in got:
        parent[find(x.doc_id)] = find(x.rep_doc_id)
        spans.setdefault((x.doc_id, x.rep_doc_id), []).append((x.start_word, x.n_words, x.rep_start_word))
    lost = [(a, b) for a, b in want if find(a) != find(b)]
    assert len(want) == 540 and len(lost) <= 5, len(lost)
    allowed = {find(a) for a, _ in want}
    assert {find(x.doc_id) for x in got} <= allowed and len(got) < 2 * len(want)


def test_members_are_compared_one_by_one_only_where_something_is_found(monkeypatch):
    """Texts that repeat a few tokens, and long ones that share one passage: what comparing every two in turn finds, with few comparisons."""
    r = np.random.default_rng(24)
    junk, groups = np.arange(1, 9, dtype=np.uint32), []
    groups.append([(i, 0, 0, r.choice(junk[: 2 + i % 6], 46), []) for i in range(150)])
    shared = r.integers(100, 1 << 31, 60).astype(np.uint32)
    rows = []
    for i in range(150):
        tokens, low = np.concatenate([r.integers(100, 1 << 31, 70), shared, r.integers(100, 1 << 31, 70)]).astype(np.uint32), int(r.integers(0, 30))
        if i > 75:  # pairs with a second passage, some places of which differ
            tokens[130:190] = rows[i - 75][3][130 - rows[i - 75][2] : 190 - rows[i - 75][2]]
            tokens[131 : 131 + i % 9] = 7
        rows.append((i, 0, low, tokens[low:], [(70, 130)] if i % 3 else []))
    groups.append(rows)
    made, plain = [], passages.matches
    monkeypatch.setattr(passages, "matches", lambda *a: made.append(1) or plain(*a))
    for members in groups:
        made.clear()
        got, few = list(passages._Beside(members, 46).pairs()), len(made)
        beside, want = passages._Beside(members, 46), []
        for u in range(len(members)):
            for v in range(u + 1, len(members)):
                want += beside._compared(u, v)
        assert got == want and len(got) > 40 and few <= 2 * len(got) + 20, (len(got), len(want), few)


# ---- chat
def test_roles_are_recovered(spark):
    r = random.Random(6)
    say = {"user": lambda: "What about " + "x " * r.randint(2, 8) + "?", "assistant": lambda: "\n".join("It is " + "word " * r.randint(30, 80) for _ in range(r.randint(2, 4))), "system": lambda: "Be brief."}
    rows, true = [], {}
    for c in range(60):
        turns = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * r.randint(1, 4)
        for t, role in enumerate(turns):
            true[c, t] = role
            rows.append((c, t, role, say[role]()))
    labelled = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.train(labelled)
    lost = [(c, t, None if r.random() < 0.3 else {"user": "Human", "assistant": "AI"}.get(role, role), x) for c, t, role, x in rows]
    got = chat.parsed(spark.createDataFrame(lost, labelled.schema), model).collect()
    begun = {(x.conv_id, x.turn): x.role for x in got if x.begins and x.line == 0}
    assert sum(begun.get(k) == v for k, v in true.items()) > 0.97 * len(true)
    exact = chat.parsed(labelled, model).collect()
    assert {(x.conv_id, x.turn): (x.role, x.text) for x in exact} == {(c, t): (role, x) for c, t, role, x in rows}
    assert exact[0].rendered == f"<|{exact[0].role}|>\n{exact[0].text}\n<|end|>"


def test_fragments_give_the_whole_path(spark):
    r = np.random.default_rng(2)
    model = chat.count([[("user", "a?"), ("assistant", "b\nc")], [("system", "x"), ("user", "q"), ("assistant", "long " * 50)]])
    seen = np.stack([r.integers(0, n, 90) for n in (5, 7, 2, 2)], 1)
    whole = model.path(seen)
    cuts = [0, 17, 18, 60, 90]
    parts = [seen[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    first = model.start + model.emissions(parts[0][:1])[0]
    for e in model.emissions(parts[0])[1:]:
        first = (first[:, None] + model.move).max(0) + e
    ends = chat.cut_states(model, [first[None], *[model.matrix(p) for p in parts[1:]]])
    got = np.concatenate([model.path(p, None if i == 0 else ends[i - 1], ends[i]) for i, p in enumerate(parts)])
    score = lambda path: model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False)) + model.emissions(seen)[np.arange(90), path].sum()
    assert abs(score(got) - score(whole)) < 1e-9
    one = [(1, t, ["user", "assistant"][t % 2], "line\nline") for t in range(400)] + [(None, 0, None, None), (2, 0, "user", ""), (2, 0, "user", "")]
    turns = spark.createDataFrame([(*x, 1, "x") for x in one], "conv_id long, turn long, role string, text string, part int, place string")
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        out = chat.parsed(turns, chat.train(turns)).collect()
    assert [x.role for x in sorted((x for x in out if x.conv_id == 1), key=lambda x: x.turn)] == ["user", "assistant"] * 200
    assert chat.parsed(turns.limit(0), model).count() == 0 and np.isfinite(chat.train(turns.limit(0)).move).all()


def test_the_path_is_the_best_of_all():
    """Viterbi against all paths, on lines with and without markers."""
    model = chat.count([[("user", "a?"), ("assistant", "b\nc")], [("system", "x"), ("user", "q\nr?"), ("assistant", "long " * 50), ("tool", "1")]])
    r = np.random.default_rng(4)
    for _ in range(12):
        seen = np.stack([r.integers(0, n, 4) for n in (5, 7, 2, 2)], 1)
        said = model.emissions(seen)
        score = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(p)) + sum(said[i, s] for i, s in enumerate(p))  # noqa: B023, E731
        best = max(map(score, itertools.product(range(chat.STATES), repeat=4)))
        assert abs(best - score(model.path(seen))) < 1e-9


def test_turns_keep_their_texts_however_they_are_dealt(spark):
    """Unmarked rows go on with a turn over many partitions; texts, indents and unknown roles stay as they are; turn numbers begin anywhere."""
    labelled = [(c, 1000 + t, role, text) for c in range(40) for t, (role, text) in enumerate([("user", "why?\nplease?"), ("assistant", "It is so.\n" * 5 + "end"), ("user", "and?"), ("assistant", "No.\nno")] * 2)]
    model = chat.train(spark.createDataFrame(labelled, "conv_id long, turn long, role string, text string"))
    again = chat.count([[(role, text) for x, _, role, text in labelled if x == c] for c in range(40)])
    assert np.allclose(model.move, again.move) and np.allclose(model.start, again.start) and all(np.allclose(a, b) for a, b in zip(model.say, again.say, strict=True))
    rows = [(7, 0, "user", "   indented code"), (7, 1, "assistant", "\n".join(f"  row {i}" for i in range(300))), (7, 2, "moderator", "hi there"), (8, 0, None, "User:  two spaces"), (8, 1, "human", "User: quoted"), (8, 2, "assistant", "x" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # a path may cut a row into turns, but all lines are there, in order and unchanged but for markers that were cut off
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).extend((text if role else text.replace("User: ", "")).split("\n"))
    got = {}
    for parts in (1, 7):
        with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions=parts):
            got[parts] = sorted(map(tuple, chat.parsed(turns, model).collect()))
    assert got[1] == got[7]
    lines = {}
    for conv, turn, line, begins, role, n, text, rendered in got[7]:
        assert rendered == f"<|{role}|>\n{text}\n<|end|>" and text.count("\n") + 1 == n
        lines.setdefault(conv, []).extend(text.split("\n"))
    assert lines == want
    assert {(c, t): role for c, t, line, _, role, *_ in got[1] if line == 0 and t < 2 and c == 7} == {(7, 0): "user", (7, 1): "assistant"}
    # one conversation whose single turn lies in many partitions
    long = [(1, t, "assistant" if t == 0 else None, f"sentence {t} goes on. " * 8) for t in range(500)]
    frame = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    both = []
    for parts in (1, 9):
        with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions=parts):
            both.append(sorted(map(tuple, chat.parsed(frame, model).collect())))
    assert both[0] == both[1]


# ---- long texts
def test_long_ranges_are_hashed_slice_by_slice(monkeypatch):
    data = np.random.default_rng(1).integers(97, 122, 3000, dtype=np.uint8)
    starts, ends = np.array([0, 0, 10, 500, 700]), np.array([3000, 0, 20, 2900, 701])
    whole = textkit.range_hashes(data, starts, ends)
    monkeypatch.setattr(textkit, "HASHED", 64)
    assert (textkit.range_hashes(data, starts, ends) == whole).all() and len(set(whole.tolist())) == 5


def test_a_long_text_takes_a_bounded_multiple_of_its_size():
    text = pa.array([" ".join(f"w{i * 7919 % 50_000}" for i in range(2_000_000))])
    size = len(text[0].as_py())
    for run in (lambda: quality.statistics(text), lambda: list(textkit.shingle_sets(text))):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25 * size

"""Line dedup, SimHash and decontamination against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from runscope.llm import decontam, line_dedup, simhash
from runscope.llm.common import connected_components
from tests.llm.edge import ROWS, SCHEMA, edge_docs, empty_docs, key


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a: str, b: str, edits: int) -> bool:
    return abs(len(a) - len(b)) <= edits and distance(a, b) <= edits


def brute_lines(rows, edits=1):
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (
        r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) - (
            1 << 64 if xxhash.xxh64_intdigest(r[1].encode(), 42) >= 1 << 63 else 0)))
    first, gone = set(), {}
    for doc in docs:
        for no, line in enumerate(doc[1].split("\n")):
            c = line_dedup.content(line)
            if c and (c in first or len(c) > 2 * edits and any(len(o) > 2 * edits and near(c, o, edits) for o in first)):
                gone.setdefault(doc, set()).add(no)
            if c:
                first.add(c)
    return gone


def lines_after(rows, edits=1):
    gone = brute_lines(rows, edits)
    out = []
    for doc in rows:
        if doc[1] is None:
            out.append(doc)
        else:
            out.append((doc[0], "\n".join(x for i, x in enumerate(doc[1].split("\n"))
                                          if i not in gone.get(doc, ()))))
    return out


def noisy(rng, s):
    i = rng.randrange(len(s))
    return rng.choice([s[:i] + s[i + 1:], s[:i] + rng.choice("abcä") + s[i:], s[:i] + rng.choice("abcä") + s[i + 1:]])


def near_line_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcä ") for _ in range(rng.randrange(1, rng.choice([6, 40])))).strip() or "x"
            for _ in range(30)]
    rows = []
    for i in range(60):
        lines = [rng.choice(base) for _ in range(rng.randrange(1, 5))]
        lines = [noisy(rng, x) if rng.random() < 0.5 else x for x in lines]
        lines = [noisy(rng, x) if rng.random() < 0.2 and x else x for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed,edits", [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 0)])
def test_line_dedup_random(spark, seed, edits):
    rows = near_line_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_lines(docs, max_edits=edits).collect()
    assert sorted(tuple(r) for r in got) == sorted(lines_after(rows, edits))


def test_line_dedup_short_lines(spark):
    rows = [(1, "And with.\nab\nabc\nno"), (2, "And, with.\nac\nabd\nno"), (3, "Xab\nbc\nabcd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "And with.\nab\nabc\nno", 2: "ac", 3: "Xab\nbc"}
    longer = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_chars=9).collect()}
    assert longer == {1: "And with.\nab\nabc\nno", 2: "ac\nabd", 3: "Xab\nbc\nabcd"}


def test_line_dedup_very_long_lines(spark):
    """Lines of 100,000 characters, and a document of very many lines that all go."""
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(100_000)).strip()
    many = "\n".join(f"line number {i * 37 % 20_000:05d} of them" * 2 for i in range(20_000))
    rows = [(1, line), (2, line[:50_000] + "Z" + line[50_001:]), (3, line[:70_000] + line[70_001:]),
            (4, line[:-3] + "XYZ"), (5, many), (6, many)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == line and got[2] == got[3] == got[6] == "" and got[4] == rows[3][1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_within_edits(edits):
    rng = random.Random(edits)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        assert line_dedup.within_edits(a, b, edits) == (distance(a, b) <= edits)


def test_line_dedup_edges(spark):
    docs = edge_docs(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted([(r["doc_id"], r["text"]) for r in rows], key=key) == sorted(
        lines_after([(r[0], r[1]) for r in ROWS]), key=key)
    for r in rows:
        if r["text"] is not None and r["doc_id"] == 10:
            assert r["n_chars"] == len(r["text"])
    report = line_dedup.line_report(docs).collect()
    assert len(report) == len(ROWS)
    assert all(r["n_dropped"] == len(r["dropped"]) for r in report)
    assert line_dedup.dedup_lines(empty_docs(spark)).collect() == []


def test_line_variants_meet():
    a, b, c = "the quick brown fox jumps", "the quick brwn fox jumps", "the quick brXwn fox jumps"
    sums = line_dedup.Prefixes([a, b, c])
    one = lambda i, masked, left_out: set(next(sums.variants(i, masked, left_out)).tolist())
    assert one(1, 0, 0) <= one(0, 0, 1) and not one(0, 0, 0) & one(2, 0, 1)
    assert one(0, 1, 0) & one(2, 1, 0)
    segments = line_dedup.Prefixes([a, b]).segments(1).tolist()
    assert set(segments[0]) & set(segments[1])


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=3):
    """fps: list of (id, fp); smallest id reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits or (fps[i][0] is not None and fps[i][0] == fps[j][0]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_edges(spark):
    got = simhash.near_duplicates(edge_docs(spark)).drop("th").collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in ROWS]
    expected = [(d, f"{fp:016x}", c) for (d, fp), c in zip(fps, brute_components(fps))]
    assert sorted([tuple(r) for r in got], key=key) == sorted(expected, key=key)
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_simhash_links(spark, hot):
    """Clusters of fingerprints a few bits apart; small HOT_ENTRIES send them through the ball index."""
    rng = random.Random(hot)
    fps = set()
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(12):
            fps.add(fp)
            for _ in range(rng.randrange(1, 5)):
                fp ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.links(nodes, hot).collect()
    named = {signed(f): f for f in fps}
    assert all((named[r["a"]] ^ named[r["b"]]).bit_count() <= 3 for r in found)
    roots = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame([tuple(r) for r in found], "a long, b long"), "a", "b").collect()}
    got = [roots.get(signed(f), signed(f)) for f in fps]
    expected = brute_components([(i, f) for i, f in enumerate(fps)])
    assert [got.index(g) for g in got] == [expected.index(e) for e in expected]


def test_keep_one(spark):
    docs = edge_docs(spark)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in ROWS]
    comp = brute_components(fps)
    ids = [r["doc_id"] for r in kept]
    assert sorted(set(i for i in ids if i is not None)) == sorted({c for c in comp if c is not None})
    # The rows without id: their one component has no name, the copies of its text stay.
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert simhash.keep_one(empty_docs(spark)).collect() == []


def test_keep_one_of_near_copies_without_id(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    base, near = " ".join(words), None
    bits = brute_fingerprint(base)
    for i in range(400):
        text = " ".join([*words[:i], "other", *words[i + 1:]])
        if 1 <= (bits ^ brute_fingerprint(text)).bit_count() <= 3:
            near = text
            break
    assert near is not None
    docs = spark.createDataFrame([(None, base), (None, near), (None, "quite another text"), (5, "a named text")],
                                 "doc_id long, text string")
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == 3 and sum(r["text"] in (base, near) for r in kept) == 1


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert connected_components(df.limit(0), "a", "b").collect() == []


def words_of(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items):
    import hashlib

    out = []
    for d in docs:
        w, hit, ids = words_of(d[1]), set(), set()
        for item_id, text in items:
            iw = words_of(text)
            if item_id is None or not iw:
                continue
            size = min(10, len(iw))
            for q in range(len(iw) - size + 1):
                for p in range(len(w) - size + 1):
                    if w[p:p + size] == iw[q:q + size]:
                        hit |= set(range(p, p + size))
                        ids.add(str(item_id))
        out.append((d[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    bool(hit)))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and THEN it runs"), (2, "lazy dog"), (3, None), (4, ""),
         (None, "quick brown"), (5, "größe äöü"), (5, "all to see"), (10, "word1 the of1 word2 the of2 word3 the of3 word4 the of4"),
         (11, "a a a a a a a a a a a a"), (12, "no such words anywhere in these documents at all, I hope so")]


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id long, text string, th string, words int")
    rows = ROWS + [(20, "b a a a a a a a a a a a a a c", "en", "s", 1), (21, "to see", "en", "s", 1)]
    docs = edge_docs(spark, rows)
    got = decontam.find_contamination(docs, items).drop("th").collect()
    expected = brute_contamination(rows, ITEMS)
    assert sorted([tuple(r) for r in got], key=key) == sorted(expected, key=key)
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not e[-1] for e in expected)
    assert decontam.find_contamination(empty_docs(spark), items).collect() == []
    clean = decontam.find_contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)


def test_decontamination_random(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    rows = []
    for d in range(40):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 20)))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts.append(" ".join(w[a:a + rng.randrange(5, 20)]))
        rows.append((d, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).drop("th")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_contamination(rows, items))


def test_decontamination_of_repeated_words(spark):
    """A text of one word 300,000 times against items that repeat it: linear in the text, and every word is hit."""
    docs = spark.createDataFrame([(1, "la " * 300_000), (2, "la " * 9 + "lo " + "la " * 12), (3, "lu " * 50)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([("a", "la " * 25), ("b", "la la"), ("c", "lo " + "la " * 11)],
                                  "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in
           decontam.find_contamination(docs, items).collect()}
    assert got == {1: (300_000, 300_000, 3), 2: (22, 22, 3), 3: (50, 0, 0)}

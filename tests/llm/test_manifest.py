"""The Merkle manifest, conversation repair and the quality classifier against brute force and on held-out rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.llm import conversation_repair as CR
from runscope.llm import merkle, queries
from runscope.llm import quality_classifier as QC
from tests.conftest import SF_ORACLE
from tests.llm.edge import ROWS, edge_docs, empty_docs, key


# ---- operator 11 ---------------------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def as_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_way(levels, i):
    for level in levels[:-1]:
        run = i // 8 * 8
        yield level[run:i], level[i + 1:run + 8]
        i //= 8


def brute_manifest(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha(*map(as_field, (doc_id, source, lang, n_chars, text)))
        changed = leaf
        if text is not None and zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 0:
            changed = sha(*map(as_field, (doc_id, source, lang, n_chars, low(text))))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: brute_tree([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in langs}
    top = brute_tree([built[x][-1][0] for x in langs])
    for at, lang in enumerate(langs):
        for i, (*_, leaf, doc_id, changed) in enumerate(sorted(trees[lang], key=lambda t: t[:3])):
            way = [*brute_way(built[lang], i), *brute_way(top, at)]
            folded = changed
            for left, right in way:
                folded = sha(*left, folded, *right)
            yield (doc_id, leaf, built[lang][-1][0], top[-1][0], sha(*[x for a, b in way for x in a + b]), folded,
                   folded == top[-1][0])


def manifest_of(df):
    return sorted((tuple(r) for r in merkle.manifest(
        df, merkle.tampered(F.col("doc_id"), F.col("text"))).collect()), key=key)


def test_manifest_edge_rows(spark):
    got = manifest_of(edge_docs(spark))
    assert got == sorted(brute_manifest(ROWS), key=key)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert manifest_of(empty_docs(spark)) == []


@pytest.mark.parametrize("n_langs,n_docs", [(1, 1), (1, 9), (20, 150), (70, 70)])
def test_manifest_sizes_and_a_hot_id(spark, n_langs, n_docs):
    rows = [(7 if i % 3 == 0 else i, f"Text {i}", f"l{i % n_langs}", None, i) for i in range(n_docs)]
    rows += [(7, "Copy", "l0", "s", 1)] * 5  # equal rows are leaves each
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_of(df.repartition(4)) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Trees higher than a chunk: chunks of 64 leaves, three rounds for 5,000 documents."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SPAN", 64)
    rows = [(i, f"T {i % 7}", "en" if i % 5 else None, "s", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    levels = []
    leaves = merkle.numbered(df.select(F.lit("x").alias("tree"), "doc_id", F.lit(b"0" * 64).alias("digest")),
                             ["doc_id"], "test")
    levels = merkle._rounds(leaves, "test")
    assert [r.count() for r in levels] == [5000, 79, 2, 1]


def test_folding_resumes_the_kept_state():
    children = [sha(str(i)).encode() for i in range(8)]
    node = merkle.Node(children)
    assert node.digest.decode() == sha(*[c.decode() for c in children])
    for slot in range(8):
        other = children[:slot] + [sha("x").encode()] + children[slot + 1:]
        assert node.fold(slot, other[slot]) == merkle.Node(other).digest
        assert node.fold(slot, children[slot]) == node.digest


# ---- operator 12 ---------------------------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """(cost, audit, lines) over all edit sequences, by a search without checkpoints. Rows: (role, text) in order."""
    seen, marks = set(), []
    for role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        marks.append("blank" if not last else "duplicate" if (role, text) in seen else
                     "truncated" if last not in ".!?" else None)
        seen.add((role, text))

    def best(i, state, inserts=2):
        """state: the initials so far, as the grammar knows them: '', 's', 'u', 'a'."""
        options = []
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text = rows[i]
            rest = best(i + 1, state)
            options.append((4 + rest[0], "D" + rest[1], rest[2]))
            if marks[i] not in ("blank", "duplicate"):
                extra = 3 * (marks[i] == "truncated")
                if role[:1] and role[:1] in fits:
                    rest = best(i + 1, role[0])
                    options.append((extra + rest[0], "K" + rest[1], (f"{role}:{text}", *rest[2])))
                for other in ("user", "assistant"):
                    if other[0] in fits:
                        rest = best(i + 1, other[0])
                        options.append((3 + extra + rest[0], "R" + rest[1], (f"{other}:{text}", *rest[2])))
        if inserts:
            for other in ("user", "assistant"):
                if other[0] in fits:
                    rest = best(i, other[0], inserts - 1)
                    options.append((3 + rest[0], "I" + rest[1], (f"{other}:", *rest[2])))
        return min(options, default=(1 << 40, "", ()))

    cost, audit, lines = best(0, "")
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    return (*(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "t") for r in rows], "conv_id long, turn long, role string, "
                                 "text string, symbol string, id long, pos int, n int, twin string")


def random_rows(rng, conv, n):
    texts = ["Fine.", "cut off", " ", "", "why?  ", "no!", "cut\n", "Other."]
    return [(conv, t, rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]),
             rng.choice(texts) if rng.random() < 0.5 else f"Line {t}{rng.choice(['.', ''])}") for t in range(n)]


def test_repair_against_all_edits(spark):
    rng = random.Random(5)
    convs = {c: random_rows(rng, c, rng.randint(1, 7)) for c in range(150)}
    df = conversations(spark, [r for rows in convs.values() for r in rows]).repartition(5)
    got = {r["conv_id"]: tuple(r)[2:] for r in CR.repair(df).collect()}
    assert got == {c: brute_repair([r[2:] for r in rows]) for c, rows in convs.items()}


def test_walk_of_blocks_of_any_size():
    """The blocks' vectors and walks give what one program over all rows gives."""
    rng = random.Random(8)
    for n in (1, 2, 3, 5, 16, 17, 200):
        symbols = "".join(rng.choice("suaxSUAX-=uauaua") for _ in range(n))
        vectors = [CR._END]
        for s in reversed(symbols):
            vectors.append(CR.before_row(s, vectors[-1]))
        whole = list(CR.walk(symbols, CR._END, CR.START))
        for width in (1, 2, 7, n):
            state, parts = CR.START, []
            for at in range(0, n, width):
                block = symbols[at:at + width]
                parts += CR.walk(block, vectors[n - at - len(block)], state)
                state = parts[-1][1]
            assert parts == whole


def test_repair_edges(spark):
    rows = [(1, None, "user", "First."), (1, 3, "assistant", "Then?"), (1, 9, "user", "Last!"),
            (None, 0, None, None), (None, None, "system", "Rules."), (3, 1, "user", "  \t"),
            (4, 2, "user", "Same."), (4, 2, "user", "Same."), (4, 2, "assistant", "Same."),
            (5, None, "user", "x" * 200_000), (5, None, "assistant", "Ünï \U0001F600 ")]
    ids = spark.createDataFrame([(1,), (77,), (None,)], "conv_id long")
    got = {r["conv_id"]: tuple(r)[1:] for r in CR.repair(conversations(spark, rows), ids).collect()}
    assert got[1] == (5, *brute_repair([("user", "First."), ("assistant", "Then?"), ("user", "Last!")]))
    assert got[None] == (0, *brute_repair([("system", "Rules."), (" ", " ")]))
    assert got[3] == (0, *brute_repair([("user", "  \t")]))
    assert got[4] == (0, *brute_repair([("assistant", "Same."), ("user", "Same."), ("user", "Same.")]))
    assert got[5] == (0, *brute_repair([("assistant", "Ünï \U0001F600 "), ("user", "x" * 200_000)]))
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert CR.repair(conversations(spark, rows).limit(0)).collect() == []


def test_repair_of_a_long_conversation(spark):
    """One conversation that holds nearly all rows, cut into blocks of its square root."""
    rng = random.Random(9)
    rows = random_rows(rng, 1, 3000) + [(2, 0, "user", "Hi.")]
    got = {r["conv_id"]: r for r in CR.repair(conversations(spark, rows).repartition(6)).collect()}
    symbols, seen = "", set()
    for _, _, role, text in rows[:3000]:
        last = text.rstrip(WHITE)[-1:]
        initial = role[:1] if role[:1] in ("s", "u", "a") and role else "x"
        symbols += "-" if not last else "=" if (role, text) in seen else \
            initial.upper() if last not in ".!?" else initial
        seen.add((role, text))
    letters = "".join(x for x, _ in CR.walk(symbols, CR._END, CR.START))
    assert got[1]["audit"].startswith(letters) and set(got[1]["audit"][len(letters):]) <= {"I"}
    vector = CR._END
    for s in reversed(symbols):
        vector = CR.before_row(s, vector)
    assert got[1]["cost"] == vector[CR.START]


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c? d") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted((tuple(r) for r in CR.damaged(conversations(spark, rows)).collect()), key=key)
    expected = []
    for conv, turn, role, text in rows:
        as_key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = role or " ", text or " "
        fate = zlib.crc32(as_key.encode()) % 20
        text = "" if fate == 1 else "A b c d" if fate == 2 and conv is not None else text
        expected += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert got == sorted(expected, key=key)


# ---- operator 13 ---------------------------------------------------------------------------------------------

def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "The the the \t  Größe naïve \n" + " ".join(f"w{i % 50}" for i in range(500)) + " " + "x" * 300
    whole = np.sort(np.concatenate(list(QC.features(text))))
    for size in (1, 10, 100):
        monkeypatch.setattr(QC, "PIECE", size)
        assert np.array_equal(np.sort(np.concatenate(list(QC.features(text)))), whole)


def test_gradient_lowers_the_loss():
    sample = [("good plain words here", 1), ("BAD!! LOUD!! WORDS!!", 0)] * 10
    before, after = QC.SubwordModel(), QC.SubwordModel().fit(sample, steps=400)
    loss = lambda m: -sum(np.log(QC.probabilities(t, m.layer(), m.bias)[y]) for t, y in sample)
    assert loss(after) < 0.2 * loss(before)


def test_layer_equals_the_mean_vector_through_the_softmax():
    model = QC.SubwordModel().fit([("one two three", 1), ("four !! five", 0)], steps=6)
    ids = np.concatenate(list(QC.features("one four six")))
    z = model.vectors[ids].mean(axis=0) @ model.out + model.bias
    p = np.exp(z - z.max())
    assert np.allclose(QC.probabilities("one four six", model.layer(), model.bias), p / p.sum(), atol=1e-5)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, 1), (9, None, 1)],
                                   "doc_id long, quality int, toxic int")
    model = QC.train(docs, labels, F.lit(True))
    got = QC.score_documents(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (3, 4, 5)} == {float(QC.probabilities("", model.layer(),
                                                                                           model.bias.astype(float))[1])}
    none = QC.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in QC.score_documents(docs, none).collect()} == {0.5}
    assert QC.score_documents(empty_docs(spark), model).collect() == []


def test_quality_held_out(spark):
    got = queries.QUERIES["op13_quality"](spark, SF_ORACLE)
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r[0] == r[1] for r in rows) / len(rows) > 0.93

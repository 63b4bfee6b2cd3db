"""The operators of this subpackage as queries over the driver tables, with their production parameters.

Queries that SQL can express have DuckDB SQL in ORACLES; the others are tested against brute force (tests/llm).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from runscope.llm import (byte_bpe, conversation_repair, decontam, langid, line_dedup, merkle, ngram_lm,
                          quality_classifier, simhash, token_binary, token_counts, topk, toxicity)
from runscope.llm.common import fold
from runscope.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return deco


def vocabulary_file(name: str) -> bytes:
    """A vocabulary file's content: read once on the driver and sent with the tasks (under 2 MB each)."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query()
def op1_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(toxicity.training_sample(docs, labels, ~held_out))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


@query()
def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


@query("""
WITH lines AS (
  SELECT doc_id, CAST(no - 1 AS INTEGER) AS line_no,
         trim(regexp_replace(line, '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS content
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
contents AS (
  SELECT content, length(content) AS n, min((doc_id, line_no)) AS pos
  FROM lines WHERE content <> '' GROUP BY content),
halves AS (
  SELECT content, n, pos, m, 0 AS side, left(content, m // 2) AS half FROM contents, (VALUES (0), (1)) AS t(less),
         LATERAL (SELECT n - less AS m) WHERE n >= 3
  UNION ALL
  SELECT content, n, pos, m, 1, right(content, m - m // 2) FROM contents, (VALUES (0), (1)) AS t(less),
         LATERAL (SELECT n - less AS m) WHERE n >= 3),
near AS (
  SELECT DISTINCT b.content FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half
  WHERE a.pos < b.pos AND CASE  -- characters, not bytes
    WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.content[i] <> b.content[i])) <= 1
    WHEN a.n = b.n + 1 THEN len(list_filter(range(1, a.n + 1),
      lambda i: a.content[:i - 1] || a.content[i + 1:] = b.content)) > 0
    WHEN b.n = a.n + 1 THEN len(list_filter(range(1, b.n + 1),
      lambda i: b.content[:i - 1] || b.content[i + 1:] = a.content)) > 0
    ELSE false END),
gone AS (
  SELECT l.doc_id, l.line_no FROM lines l JOIN contents c ON l.content = c.content
  WHERE (l.doc_id, l.line_no) > c.pos OR l.content IN (SELECT content FROM near)),
per_doc AS (SELECT doc_id, count(*) AS n, list(line_no ORDER BY line_no) AS dropped FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_dropped,
       coalesce(g.dropped, []) AS dropped,
       array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))),
         lambda i: NOT list_contains(coalesce(g.dropped, []), i)), lambda i: string_split(d.text, chr(10))[i + 1]),
         chr(10)) AS text
FROM documents d LEFT JOIN per_doc g ON d.doc_id = g.doc_id""")
def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


@query()
def op4_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_WORDS = ("regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@query(f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS span FROM (
    SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
    FROM docs, (SELECT DISTINCT l FROM spans) AS t WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, i, l FROM places JOIN spans USING (l, span)),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM hits)
          GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op5_decontamination(spark, sf_dir):
    found = decontam.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("th")


@query()
def op6_lm_scoring(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    learn = fold(F.col("doc_id"), 5) != 1
    return ngram_lm.score_documents(docs, ngram_lm.train(docs, learn), learn)


@query()
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("th")


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5""")
def op8_top_k(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query()
def op9_token_binary(spark, sf_dir):
    return token_binary.token_documents(read_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"),
                                        end_id=2)


@query()
def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_decode(read_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


#: crc32 of an expression's text in plain SQL: bit by bit over its bytes (ASCII).
_CRC32 = """xor(4294967295, list_reduce(
  list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
  lambda crc, byte: list_reduce(list_transform(range(8), lambda i: CAST(i AS BIGINT)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, byte)),
  CAST(4294967295 AS BIGINT)))"""

_LEAF = " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || "
                    f"CAST({c} AS VARCHAR), '-')" for c in merkle.FIELDS)


@query(f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf, {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS bad,
         source, n_chars, text FROM documents),
low AS (SELECT * REPLACE (translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text)
        FROM docs),
leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN bad AND text IS NOT NULL THEN sha256({_LEAF}) ELSE leaf END AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM low),
nodes AS (
  SELECT lang, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, n, i // 8),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, n, i // 8),
runs AS (
  SELECT lang, level, i // 8 AS run, list(digest ORDER BY i) AS run_digests FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT s.lang, 1000 + t.level, s.i // CAST(pow(8, t.level + 1) AS BIGINT) AS run, t.run_digests
  FROM subroots s JOIN (SELECT level, i // 8 AS run, list(digest ORDER BY i) AS run_digests FROM tops WHERE n > 1
                        GROUP BY ALL) t ON t.run = s.i // CAST(pow(8, t.level + 1) AS BIGINT)),
steps AS (
  SELECT l.doc_id, l.i AS leaf_no, l.lang, r.level, r.run_digests,
         CASE WHEN r.level < 1000 THEN l.i // CAST(pow(8, r.level) AS BIGINT) % 8
              ELSE s.i // CAST(pow(8, r.level - 1000) AS BIGINT) % 8 END + 1 AS slot
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  JOIN runs r ON r.lang IS NOT DISTINCT FROM l.lang
    AND r.run = CASE WHEN r.level < 1000 THEN l.i // CAST(pow(8, r.level + 1) AS BIGINT)
                     ELSE s.i // CAST(pow(8, r.level - 999) AS BIGINT) END),
ways AS (
  SELECT lang, leaf_no, list(array_to_string(run_digests[:slot - 1], '') || '-' ||
                             array_to_string(run_digests[slot + 1:], '') ORDER BY level) AS way
  FROM steps GROUP BY lang, leaf_no),
folded AS (
  SELECT l.*, sha256(replace(coalesce(array_to_string(w.way, ''), ''), '-', '')) AS proof_sha256,
         list_reduce(list_prepend(l.changed, coalesce(w.way, [])),
                     lambda d, x: sha256(split_part(x, '-', 1) || d || split_part(x, '-', 2))) AS folded_root
  FROM leaves l LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM l.lang AND w.leaf_no = l.i)
SELECT f.doc_id, f.leaf, s.digest AS subroot, t.digest AS root, f.proof_sha256, f.folded_root,
       f.folded_root = t.digest AS verified
FROM folded f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON t.n = 1""")
def op11_merkle_manifest(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.tampered(F.col("doc_id"), F.col("text")))


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _edit(letter: str, cost: str, after: str, line: str | None = None) -> str:
    lines = f"list_prepend({line}, {after}.r)" if line else f"{after}.r"
    return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 'r': {lines}}}"


def _least(state: int) -> str:
    """The best way on from a state through one row, before rows are put in: the least of (cost, audit)."""
    role, to = ("assistant", 3) if state == 2 else ("user", 2)
    keep = _edit("K", "extra", f"a{to}", "role || ':' || text")
    options = [_edit("D", "4", f"a{state}"),
               f"CASE WHEN NOT must AND initial = '{role[0]}' THEN {keep} END",
               f"CASE WHEN NOT must THEN {_edit('R', '3 + extra', f'a{to}', chr(39) + role + ':' + chr(39) + ' || text')} END"]
    if state == 0:
        options.append(f"CASE WHEN NOT must AND initial = 's' THEN {_edit('K', 'extra', 'a1', 'role || chr(58) || text')} END")
    return f"list_min([x for x in [{', '.join(options)}] if x IS NOT NULL])"


_INSERT_A, _INSERT_U = "'assistant:'", "'user:'"


@query(f"""
WITH RECURSIVE fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20
           AS fate FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS twin
  FROM fates WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), twin) AS pos,
         right(rtrim(text, {_WHITE}), 1) AS last, role[1] AS initial FROM hurt),
faults AS (
  SELECT *, CASE WHEN last = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed),
marked AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
  FROM faults),
back AS (
  SELECT conv_id, max(pos) + 1 AS pos, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS a0,
         {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} AS a1, {{'c': 3, 'a': 'I', 'r': ['assistant:']}} AS a2,
         {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS a3
  FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, list_min([w0, {_edit('I', '3', 'v2', _INSERT_U)}]), list_min([w1, {_edit('I', '3', 'v2', _INSERT_U)}]),
         v2, list_min([w3, {_edit('I', '3', 'w2', _INSERT_U)}])
  FROM (SELECT *, list_min([w2, {_edit('I', '3', 'w3', _INSERT_A)}]) AS v2
        FROM (SELECT m.conv_id, m.pos, {', '.join(f'{_least(q)} AS w{q}' for q in range(4))}
              FROM back b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.pos = b.pos - 1))),
ways AS (SELECT conv_id, a0 FROM back WHERE pos = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank,
       coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(coalesce(w.a0.c, 0) AS BIGINT) AS cost, coalesce(w.a0.a, '') AS audit,
       sha256(coalesce(array_to_string(w.a0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM i.conv_id""")
def op12_conversation_repair(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows.select("conv_id"))


@query()
def op13_quality(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = quality_classifier.train(docs, labels, ~held_out)
    return quality_classifier.score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

"""The registered queries of these operators: each applies one operator, with production parameters,
to its whole table. ORACLES holds DuckDB SQL where SQL can express a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, conversation_repair, exact_dedup, fingerprints, html_extract, mixing, near_dedup, packing, prefix_trie, quality, sharding, token_counts, toxicity


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op4_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_mix_sources, op3_pack_sequences, op4_extract_main_text, op5_exact_dedup,
    op6_fingerprint, op7_token_counts, op8_quality, op9_shard, op10_toxicity,
    op11_repair_conversations, op12_bpe_round_trip, op13_prefix_trie,
)}

#: crc32 of ASCII texts in SQL: the table of bytes, then one step a letter.
_CRC_TABLE = """bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _least(*ways: tuple[str, str]) -> str:
    """The least of several (condition, struct) in SQL."""
    return "list_min([" + ", ".join(f"CASE WHEN {when} THEN {way} END" for when, way in ways) + "])"


def _way(state: str, cost: str, letter: str, line: str | None) -> str:
    kept = f"{state}.kept || CASE WHEN {state}.kept = '' THEN '' ELSE chr(10) END || {line}" if line else f"{state}.kept"
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'kept': {kept}}}"


_HELD = "NOT (blank OR again)"
_CUT = "CASE WHEN cut THEN 3 ELSE 0 END"
_HOLDS = ("a", "b", "c", "d")  # nothing yet, after the system, a user, an assistant turn


def _enter(target: str) -> str:
    keep = {"b": [("a", "s")], "c": [("a", "u"), ("b", "u"), ("d", "u")], "d": [("c", "a")]}.get(target, [])
    change = {"c": [("a", "user"), ("b", "user"), ("d", "user")], "d": [("c", "assistant")]}.get(target, [])
    ways = [(f"{target} IS NOT NULL", _way(target, "4", "D", None))]
    ways += [(f"{s} IS NOT NULL AND {_HELD} AND left(role, 1) = '{i}'", _way(s, _CUT, "K", "role || ':' || text")) for s, i in keep]
    ways += [(f"{s} IS NOT NULL AND {_HELD}", _way(s, f"3 + {_CUT}", "R", f"'{r}:' || text")) for s, r in change]
    return f"{_least(*ways)} AS {target}"


def _insert(target: str, *sources: str) -> str:
    role = "user" if target == "c" else "assistant"
    return f"{_least((f'{target} IS NOT NULL', target), *((f'{s} IS NOT NULL', _way(s, '3', 'I', chr(39) + role + ':' + chr(39))) for s in sources))} AS {target}"


_WORDS = r"regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')"

ORACLES = {
    # sorts every row of a source by its hash, which the operator never does
    "op2_mix_sources": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({_WORDS}), 0) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents t),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, (3 * source_size)::DOUBLE / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY full_at, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY full_at, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
v AS (SELECT arg_min(level, full_at) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, v.level * weight) AS target FROM l, v),
g AS (SELECT *, round(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.passes, g.goal - g.passes * g.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS mine
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + CASE WHEN upto <= budget THEN size
  WHEN upto - mine <= budget AND mine > 0 THEN floor(size * (budget - upto + mine) / mine) ELSE 0 END)::BIGINT AS taken FROM c""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    # one step of the recursion reads the next turn of every conversation
    "op11_repair_conversations": rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, bits),
r AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o, range(2) c(copy) WHERE k <> 0 AND copy <= CASE WHEN k = 3 THEN 1 ELSE 0 END),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
    regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') AS cut FROM r),
n AS (SELECT *, row_number() OVER g AS n, lag(left(role, 1)) OVER g || left(role, 1) AS pair FROM f
  WINDOW g AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY conv_id),
zero AS (SELECT {{'cost': 0::BIGINT, 'audit': '', 'kept': ''}} AS a, CASE WHEN false THEN {{'cost': 0::BIGINT, 'audit': '', 'kept': ''}} END AS b,
    {{'cost': 3::BIGINT, 'audit': 'I', 'kept': 'user:'}} AS c, {{'cost': 6::BIGINT, 'audit': 'II', 'kept': 'user:' || chr(10) || 'assistant:'}} AS d),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, a, b, c, d FROM (SELECT DISTINCT conv_id FROM conversations), zero
  UNION ALL
  SELECT conv_id, n, a, b, c, {_insert("d", "c")} FROM (SELECT conv_id, n, a, b, {_insert("c", "a", "b", "d")}, d FROM (
    SELECT w.conv_id, t.n, {", ".join(map(_enter, _HOLDS))} FROM walk w JOIN n t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1))),
done AS (SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, list_min([a, d]) AS best
  FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.n = coalesce(c.n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(best.kept) AS repaired_sha256 FROM done""",
    # compares all pairs of nodes, which the operator never does
    "op13_prefix_trie": rf"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS t, turn,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS n FROM t),
ids AS (SELECT conv_id, coalesce({_crc32("conv_id::VARCHAR")} % 4, 0) AS h FROM (SELECT DISTINCT conv_id FROM conversations), bits),
r AS (SELECT i.conv_id, 0 AS own, o.n, o.t, o.words FROM ids i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 20 AND o.n <= i.h
  UNION ALL SELECT i.conv_id, 1, o.n, o.t, o.words FROM ids i JOIN o ON o.conv_id IS NOT DISTINCT FROM i.conv_id AND o.n > i.h),
p AS (SELECT conv_id, 0::BIGINT AS depth, '' AS path, 0 AS words FROM ids UNION ALL
  SELECT conv_id, row_number() OVER g, string_agg(t, '') OVER g, words FROM r WINDOW g AS (PARTITION BY conv_id ORDER BY own, n)),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM l GROUP BY depth, path),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND left(m.path, len(n.path)) = n.path) AS n_children FROM n)
SELECT a.conv_id, a.depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves,
  sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM c a LEFT JOIN c up ON up.depth = a.depth - 1 AND up.path = left(a.path, 64 * (a.depth - 1)::INT)
JOIN c b ON b.depth >= a.depth AND starts_with(b.path, a.path)
GROUP BY a.conv_id, a.depth, a.path, up.conv_id, a.n_convs, a.n_children, a.ends""",
}

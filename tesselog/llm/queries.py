"""The queries of the problems on texts, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselog.llm import conversations, encoding, neighbours, packing, sentences, spans, splitting
from tesselog.session import spread, table

_PIECE = ("chunk_id", "piece_no", "start_char", "end_char", "start_line", "end_line")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "messages")).select("session_id", "turn_no", "message_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, sf_dir, "cached_index"))


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other vectors of each distinct direction, with the number of its copies, whatever their length."""
    near, members = neighbours.nearest(table(spark, sf_dir, "cached_index"))
    copies = members.groupBy("head").count()
    return near.join(copies, near["a"] == copies["head"]).selectExpr("a AS vec_id", "b AS neighbour_id", "round(cosine, 5) AS cosine", "count AS copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks")).select(*_PIECE)


def p5_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that end in the deepest valley of lexical cohesion."""
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), splitting.cohesion_depths).select(*_PIECE)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's, or piece's, container of 2 048 tokens and its place there."""
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in others."""
    return spans.shared_share(table(spark, sf_dir, "documents"))


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sentences in runs that others hold, and what is left without those that aren't the first."""
    out = sentences.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "shared_sentences", "removed_sentences", "shared_chars", "removed_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p3_found between directions, with the numbers of their copies, not expanded."""
    pairs, members = neighbours.close_classes(table(spark, sf_dir, "cached_index"))
    sizes = members.where("vec_id = head").select("head", "n")
    first, second = (sizes.select(F.col("head").alias(c), F.col("n").alias(f"copies_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").selectExpr("a AS vec_id_a", "b AS vec_id_b", "copies_a", "copies_b")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_nearest, p3_classes, p5_found, p5_cohesion, p6_ids, p7_pack, p8_found, p8_share, p8_sentences)}

_STOPS = "".join(sentences.STOPS).replace("\n", "\\n")
SQL: dict[str, str] = {
    "p8_sentences": rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^{_STOPS}]*[{_STOPS}]+[ \t\r\n]*|[^{_STOPS}]+') AS s FROM documents),
r AS (SELECT doc_id, i, s[i + 1 : i + 3] AS part FROM (SELECT doc_id, s, unnest(generate_series(0, len(s) - 3)) AS i FROM d WHERE len(s) >= 3)),
h AS (SELECT doc_id, i, md5(array_to_string(part, '')) AS h FROM r WHERE length(array_to_string(part, '')) >= 100),
g AS (SELECT h, min((doc_id, i)) AS first FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, i + j AS i, bool_or((doc_id, h.i) <> first) AS again FROM h JOIN g USING (h), generate_series(0, 2) x(j) GROUP BY 1, 2),
m AS (SELECT c.doc_id, count(*) AS shared, sum(length(s[c.i + 1])) AS shared_chars, coalesce(sum(length(s[c.i + 1])) FILTER (again), 0) AS removed_chars, list(c.i) FILTER (again) AS gone FROM c JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(shared, 0)::BIGINT AS shared_sentences, coalesce(len(gone), 0)::BIGINT AS removed_sentences, coalesce(shared_chars, 0)::BIGINT AS shared_chars, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
md5(CASE WHEN coalesce(len(gone), 0) = 0 THEN coalesce(text, '') ELSE array_to_string(list_transform(list_filter(generate_series(0, len(s) - 1), lambda k: NOT list_contains(gone, k)), lambda k: s[k + 1]), '') END) AS digest FROM d LEFT JOIN m USING (doc_id)""",
}

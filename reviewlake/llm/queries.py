"""The queries of this subpackage: name -> (session, data directory) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import doc_pairs, graph_knn, leakage, origin, packing, pieces, spam, syntax

#: Widths of the embedding models.
WIDTHS = {"code-embed-64": 64, "code-embed-mini-48": 48}


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return graph_knn.neighbour_pairs(table(spark, directory, "chunk_vectors"), 10, WIDTHS)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return doc_pairs.found(table(spark, directory, "source_files"))


def p2_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return doc_pairs.function_doc_pairs(table(spark, directory, "source_files"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return pieces.split_chunks(table(spark, directory, "chunks"))


def p4_merged(spark: SparkSession, directory: str) -> DataFrame:
    return pieces.split_chunks(table(spark, directory, "chunks"), by=pieces.merge_segments)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return origin.not_hand_written(table(spark, directory, "source_files"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return syntax.invalid_files(table(spark, directory, "source_files"))


def p6_rates(spark: SparkSession, directory: str) -> DataFrame:
    return syntax.failure_rates(table(spark, directory, "source_files"))


def p7_batches(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(table(spark, directory, "documents"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """What was covered of each item, passages in another order among them."""
    return leakage.coverage(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return spam.spam_documents(table(spark, directory, "documents"))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "p" and k[1:2].isdigit()}


#: The rule of problem 4 with running sums of line and word lengths, one recursion step a piece.
P4_SQL = r"""
with recursive c as (select distinct chunk_id, coalesce(line_start, 1) line_start, content, length(content) n from chunks where chunk_id is not null and length(content) > 1600),
ln as (select chunk_id, unnest(a) x, generate_subscripts(a, 1) i, len(a) k from (select chunk_id, string_split(content, chr(10)) a from c)),
le as (select chunk_id, i, k, sum(length(x) + 1) over (partition by chunk_id order by i) e, trim(x, ' ' || chr(9) || chr(13)) = '' blank from ln),
l as (select chunk_id, coalesce(list(e order by e) filter (where i < k), []) ends, coalesce(list(e order by e) filter (where i < k and blank), []) blanks from le group by chunk_id),
wd as (select chunk_id, unnest(a) x, generate_subscripts(a, 1) i, len(a) k from (select chunk_id, regexp_split_to_array(content, '[ \t]') a from c)),
we as (select chunk_id, i, k, sum(length(x) + 1) over (partition by chunk_id order by i) e from wd),
w as (select chunk_id, coalesce(list(e order by e) filter (where i < k), []) ends from we group by chunk_id),
b as (select c.chunk_id, c.line_start, c.n, l.ends, l.blanks, w.ends spaces from c join l using (chunk_id) join w using (chunk_id)),
p as (
  select chunk_id, 0::bigint piece_no, 0::bigint s, 120::bigint e, false done from b
  union all
  select chunk_id, piece_no + 1, s2, case when n - s2 <= 1600 then n else coalesce(list_filter(blanks, lambda x: x > s2 + 800 and x <= s2 + 1600)[-1], list_filter(ends, lambda x: x > s2 + 800 and x <= s2 + 1600)[-1], list_filter(spaces, lambda x: x > s2 + 800 and x <= s2 + 1600)[-1], s2 + 1600) end, n - s2 <= 1600
  from (select b.*, p.piece_no, p.e - 120 s2 from p join b using (chunk_id) where not p.done))
select p.chunk_id, piece_no, (b.line_start + len(list_filter(ends, lambda x: x <= s)))::bigint as line_start, (b.line_start + len(list_filter(ends, lambda x: x <= e - 1)))::bigint as line_end, s::bigint as char_start, e::bigint as char_end
from p join b using (chunk_id) where piece_no > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL}

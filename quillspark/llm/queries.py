"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import format_duplicates, leakage, mixing, near_duplicates, neighbours, splitting, truncation
from quillspark.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


#: TESTDATA.md states problem 1 on runs of three words at a similarity of 0.6.
P1 = {"width": 3, "threshold": 0.6}


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks that are no dose facts."""
    return table(spark, sf_dir, "raw_chunks").where("layout_type is null or layout_type <> 'structured_fact'")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: near_duplicates.groups(_prose(s, d), **P1),
        "p1_classes": lambda s, d: near_duplicates.classes(_prose(s, d), **P1),
        "p1_recall": lambda s, d: near_duplicates.recall(_prose(s, d), **P1),
        "p2_found": lambda s, d: splitting.boundary_levels(table(s, d, "raw_chunks")),
        "p2_pieces": lambda s, d: splitting.pieces_of_table(table(s, d, "raw_chunks")),
        "p2_files": lambda s, d: splitting.pieces_of_files(s, splitting.files_of_table(table(s, d, "raw_chunks"))).drop("path"),
        "p4_found": lambda s, d: neighbours.neighbour_pairs(table(s, d, "index_docs")),
        "p4_recall": lambda s, d: neighbours.recall(table(s, d, "index_docs")),
        "p5_found": lambda s, d: format_duplicates.copies(table(s, d, "raw_chunks")),
        "p5_records": lambda s, d: format_duplicates.records(table(s, d, "raw_chunks")),
        "p5_collisions": lambda s, d: format_duplicates.collisions(table(s, d, "raw_chunks")),
        "p6_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id"),
        "p6_cleaned": lambda s, d: leakage.decontaminate(table(s, d, "documents"), table(s, d, "eval_items")),
        "p7_mixture": lambda s, d: mixing.mixed(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
        "p7_shares": lambda s, d: mixing.mixed(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
        "p8_found": lambda s, d: truncation.judged(table(s, d, "documents")).select("doc_id"),
        "p8_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
    }


# SQL fragments: white space as Python and TESTDATA.md see it, and the words of a text.
_W = r"\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

#: Exact similarities of all pairs that share a run of three words, and the closure of the links.
_P1 = f"""
    with recursive w as (select row_id, lower(set_id) as set_id, {_WORDS.format("verbatim_text")} as w from raw_chunks where (layout_type is null or layout_type <> 'structured_fact') and verbatim_text is not null),
    g as (select distinct row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) as gram from w where len(w) >= 3),
    n as (select row_id, count(*) as n from g group by row_id),
    s as (select a.row_id as a, b.row_id as b, count(*) as shared from g a join g b on a.gram = b.gram and a.row_id < b.row_id group by 1, 2),
    l as (select a, b from s join n x on x.row_id = s.a join n y on y.row_id = s.b where shared >= 0.6 * (x.n + y.n - shared) - 1e-9),
    e as (select a, b from l union select b, a from l),
    r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
    m as (select a as row_id, least(a, min(b)) as group_row_id from r group by a),
    k as (select group_row_id from m join w using (row_id) group by 1 having count(distinct set_id) > 1)
    select group_row_id, row_id from m join k using (group_row_id) where row_id <> group_row_id"""

#: Units of each level by splitting; a line break of two characters counts once and keeps its length.
_P2 = f"""
    with t as (select row_id, replace(verbatim_text, chr(13) || chr(10), ' ' || chr(10)) as t from raw_chunks where length(verbatim_text) > 1000),
    c as (select row_id, t, regexp_replace(t, '[{_W}]*[\\n\\r][{_W}]*[\\n\\r][{_W}]*', chr(1), 'g') as p from t),
    u as (select row_id, string_split(p, chr(1)) as p, string_split(regexp_replace(p, '([.!?])[{_W}]+', '\\1' || chr(1), 'g'), chr(1)) as s, string_split_regex(t, '[{_W}]+') as w from c),
    m as (select row_id, list_max(list_transform(p, lambda x: length(regexp_replace(x, '^[{_W}]+|[{_W}]+$', '', 'g')))) as p, list_max(list_transform(s, lambda x: length(regexp_replace(x, '^[{_W}]+|[{_W}]+$', '', 'g')))) as s, list_max(list_transform(w, lambda x: length(x))) as w from u)
    select row_id, case when p <= 1000 then 'paragraph' when s <= 1000 then 'sentence' when w <= 1000 then 'word' else 'character' end as boundary from m"""

#: Points and commas between digits are kept by marks; each is put twice, since neighbouring ones share a digit.
_MARK = "regexp_replace({0}, '(\\p{{Nd}})([.])(\\p{{Nd}})', '\\1\ue000\\3', 'g')"
_MARK2 = "regexp_replace({0}, '(\\p{{Nd}})(,)(\\p{{Nd}})', '\\1\ue001\\3', 'g')"


def _canon(text: str) -> str:
    for _ in range(2):
        text = _MARK2.format(_MARK.format(text))
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\ue000\ue001]+', ' ', 'g'), ' ')"


_FIELD = r"(?s)^[^\p{L}\p{N}:]*[\p{L}\p{N}]+(?:[^\p{L}\p{N}:]+[\p{L}\p{N}]+){0,2}[^\p{L}\p{N}:]*:.*[\p{L}\p{N}]"
#: Rows take the least row of their word sequence and of their list of fields in turn.
_P5 = f"""
    with t as (select row_id, {_canon("verbatim_text")} as s, list_filter(string_split_regex(verbatim_text, '[;|\\r\\n]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as p from raw_chunks where verbatim_text is not null),
    f as (select row_id, s, case when len(p) >= 3 and len(list_filter(p, lambda x: not regexp_matches(x, '{_FIELD}'))) = 0 then array_to_string(list_sort(list_transform(p, lambda x: {_canon("split_part(x, ':', 1)")} || chr(2) || {_canon("substr(x, instr(x, ':') + 1)")})), chr(3)) end as f from t where s <> ''),
    a1 as (select *, min(row_id) over (partition by s) as m from f),
    a2 as (select row_id, s, f, case when f is null then m else min(m) over (partition by f) end as m from a1),
    a3 as (select row_id, s, f, min(m) over (partition by s) as m from a2),
    a4 as (select row_id, s, f, case when f is null then m else min(m) over (partition by f) end as m from a3),
    a5 as (select row_id, min(m) over (partition by s) as m from a4)"""

_P6 = f"""
    with i as (select item_id, {_WORDS.format("text")} as w from eval_items), d as (select doc_id, {_WORDS.format("text")} as w from documents),
    a as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k+12], ' '))) as g from i where len(w) >= 13),
    b as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k+12], ' '))) as g from d where len(w) >= 13)
    select distinct doc_id, item_id from a join b using (g)"""


def _p4_field(field: str, size: int) -> str:
    """Exact neighbours: the five greatest cosines of every usable vector of a current row, ties to the smaller id."""
    return f"""
        select '{field}' as field, least(a, b) as index_id_a, greatest(a, b) as index_id_b from (
            select x.index_id as a, y.index_id as b from (select index_id, {field}::double[] as v from now where len({field}) = {size} and not list_bool_or(list_transform({field}, lambda z: z is null or not isfinite(z))) and list_sum(list_transform({field}, lambda z: abs(z))) > 0) x,
            (select index_id, {field}::double[] as v from now where len({field}) = {size} and not list_bool_or(list_transform({field}, lambda z: z is null or not isfinite(z))) and list_sum(list_transform({field}, lambda z: abs(z))) > 0) y
            where x.index_id <> y.index_id qualify row_number() over (partition by x.index_id order by list_cosine_similarity(x.v, y.v) desc, y.index_id) <= 5)"""


_P4 = f"""
    with now as (select * from index_docs qualify row_number() over (partition by coalesce(urn_id, chr(1) || index_id) order by indexed_at desc nulls last, index_id desc) = 1)
    {" union ".join(_p4_field(f, n) for f, n in neighbours.FIELDS.items())}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_found": _P2,
        "p4_found": _P4,
        "p5_found": f"{_P5} select m as keep_row_id, row_id as copy_row_id from a5 where m <> row_id",
        "p5_records": f"{_P5} select m as keep_row_id, count(*)::bigint as copies from a5 group by m",
        "p6_found": _P6,
    }

"""SQL of the pN queries that SQL can express, each over the whole tables."""

from __future__ import annotations


def _slug(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


def _doi(c: str) -> str:
    return f"('d:' || rtrim(left(nullif(regexp_extract({_slug(c)}, '(?:^|-)(10-[0-9]{{4,9}}-[a-z0-9].*)$', 1), ''), 72), '-'))"


def _pmc(c: str) -> str:
    return f"('p:' || nullif(nullif(regexp_extract({_slug(c)}, '^(?:(?:.*-)?pmc-?)?([0-9]{{8}})$', 1), ''), '00000000'))"


PANEL_ID = r"""regexp_replace(paper_id || '__fig' || case when length(figure_index::varchar) < 2 then lpad(figure_index::varchar, 2, '0') else figure_index::varchar end
    || '_' || coalesce(nullif(panel_label, ''), 'panel' || panel_ordinal), '[^A-Za-z0-9_.-]+', '_', 'g')"""

ARTICLES = f"""named as (
    select distinct paper_id, {_doi("paper_id")} a0, {_pmc("paper_id")} a1, {_doi("doi")} b, {_pmc("pmcid")} c from panels where paper_id is not null
), keyed as (
    select paper_id, case when len(ks) > 0 then ks else ['r:' || paper_id] end ks from (
        select paper_id, list_filter([coalesce(a0, a1), b, c], lambda x: x is not null) ks from named)
), link as (
    select distinct unnest(ks) x, ks[1] y from keyed
), pair as (
    select x, y from link union select y, x from link
), reach(x, y) as (
    select x, y from pair union select r.x, p.y from reach r join pair p on r.y = p.x
), label as (
    select x entity, least(x, min(y)) label from reach group by x
), home as (
    select l.label, min(k.paper_id) home_id from keyed k join label l on l.entity = k.ks[1] group by l.label
)"""

SCORES = """score as (
    select panel_id, greatest(0, least(10, s)) score from (
        select panel_id, overall_quality_score s, row_number() over (partition by panel_id order by scored_at desc nulls last, ingested_at desc nulls last, overall_quality_score desc) k
        from qwen_panel_scoring where panel_id is not null and overall_quality_score is not null and not isnan(overall_quality_score))
    where k = 1
)"""

_LEVELS = ("complexity_level", "threshold_complexity_level", "original_complexity_level")


def _fold(c: str) -> str:
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    return rf"regexp_replace(lower(translate({c}, '{wide}', '{narrow}')), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _known(column: str, targets: str, value: str) -> str:
    return f"(select min(k.{column}) from (select distinct {column} from {targets}) k where {_fold('k.' + column)} = {_fold('latest.' + value)})"


def _records(targets: str, columns: str) -> str:
    return f"""latest as (
    select * from (select *, row_number() over (partition by panel_id order by loaded_at desc nulls last, subject desc nulls last, subtype desc nulls last) k from samples
        where panel_id is not null and trim(panel_id) not in ('', 'unknown'))
    where k = 1
), record as (select panel_id, {columns} from latest)"""


LABELLED = _records(
    "mix_targets",
    ", ".join(
        [f"{_known('subject', 'mix_targets', 'subject')} subject", f"{_known('subtype', 'mix_targets', 'subtype')} subtype"]
        + ["coalesce(" + ", ".join(_known("complexity_level", "mix_targets", c) for c in _LEVELS) + ") complexity_level"]
    ),
)

BEST = f"""best as (
    select i.panel_id, s.score, l.label article from (select {PANEL_ID} panel_id, min(ks[1]) entity from (
        select p.*, k.ks from panels p join (select paper_id, min(ks) ks from keyed group by paper_id) k using (paper_id)) group by 1) i
    join score s using (panel_id) join label l on l.entity = i.entity
), ranked as (select *, row_number() over (partition by article order by score desc, panel_id) k from best)"""

CUT = """cut as (
    select subject, max(score) cutoff, max(score) filter (kept * 1000 >= keep_permille * scored) low from (
        select subject, score, keep_permille, count(*) over (partition by subject order by score desc) kept, count(*) over (partition by subject) scored
        from record join score using (panel_id) join keep_targets using (subject))
    group by subject
)"""

NEED = """need as (
    select quota_no, draw_name, greatest(min_rows, target_permille * (size_permille * (select count(*) from record) // 1000) // 1000) needed,
        (select count(*) from record r where (q.subject is null or r.subject = q.subject) and (q.subtype is null or r.subtype = q.subtype)
            and (q.complexity_level is null or r.complexity_level = q.complexity_level)) available
    from mix_targets q
)"""

SQL: dict[str, str] = {
    "p1_found": f"""with recursive {ARTICLES}, own as (
        select distinct panel_id, regexp_extract(panel_id, '(?s)^(.*)__fig', 1) prefix from samples where panel_id like '%\\_\\_fig%' escape '\\'
        and trim(panel_id) not in ('', 'unknown')
    ) select panel_id, home_id paper_id from own join label on entity = coalesce({_doi("prefix")}, {_pmc("prefix")}, 'r:' || prefix)
    join home using (label) where prefix <> home_id""",
    "p1_split_report": "select split_name, true near, 0::bigint torn from split_targets",
    "p2_found": f"with recursive {ARTICLES}, {SCORES}, {BEST} select panel_id from ranked where k > 16",
    "p2_kept": f"with recursive {ARTICLES}, {SCORES}, {BEST} select panel_id, score from ranked where k <= 16",
    "p2_nested": f"""with recursive {ARTICLES}, {SCORES}, {BEST}, journals as (
        select l.label article, min(nullif(trim(p.journal), '')) journal from panels p join (select paper_id, min(ks) ks from keyed group by paper_id) k using (paper_id)
        join label l on l.entity = k.ks[1] group by l.label
    ), one as (select *, row_number() over (partition by regexp_extract(panel_id, '(?s)^(.*)__fig', 1) order by score desc, panel_id) a from best
    ), two as (select *, row_number() over (partition by article order by score desc, panel_id) b from one where a <= 6
    ), three as (select *, row_number() over (partition by coalesce(journal, '') order by score desc, panel_id) c from two left join journals using (article) where b <= 16)
    select panel_id, score from three where c <= (select count(*) // 10 from best)""",
    "p3_found": f"with {LABELLED}, {NEED} select quota_no from need where available < needed",
    "p3_needs": f"with {LABELLED}, {NEED} select quota_no, needed::bigint needed, available from need",
    "p4_found": f"""with {_records("mix_targets", _known("subtype", "mix_targets", "subtype") + " subtype")}, {SCORES} select subtype, panel_id from (
        select subtype, panel_id, row_number() over (partition by subtype order by score desc, panel_id) k from record join score using (panel_id) where subtype is not null)
    where k <= 12""",
    "p5_found": f"""with {_records("keep_targets", _known("subject", "keep_targets", "subject") + " subject")}, {SCORES}, {CUT}
    select subject, panel_id from record join score using (panel_id) join cut using (subject) where score >= low""",
    "p5_cutoffs": f"""with {_records("keep_targets", _known("subject", "keep_targets", "subject") + " subject")}, {SCORES}, {CUT}
    select subject, low cutoff, count(*) filter (score >= low) kept, count(*) scored from record join score using (panel_id) join cut using (subject) group by subject, low""",
    "p5_closest": f"""with {_records("keep_targets", _known("subject", "keep_targets", "subject") + " subject")}, {SCORES}, each as (
        select distinct subject, score, keep_permille, kept, scored from (
            select subject, score, keep_permille, count(*) over (partition by subject order by score desc) kept, count(*) over (partition by subject) scored
            from record join score using (panel_id) join keep_targets using (subject)))
    select subject, cutoff, kept, scored from (
        select subject, score cutoff, kept, scored, row_number() over (partition by subject order by abs(kept * 1000 - keep_permille * scored), score desc) k from each)
    where k = 1""",
}

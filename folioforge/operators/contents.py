"""Tables of contents: where each begins and ends, and the rows in it.

Regions are relational: every start gets its end from one of three rules (see ``contents_ends``), then a fold over the
starts of a document leaves out those that lie inside a region. A start whose end cannot be told opens no region and is
reported with its state. Rows (``parse_rows``) are a state machine over one region's items, in tasks by region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folioforge.executors import ship
from folioforge.plans.catalog import operator, view

TOC_START = r"^table of contents( [(]continued[)])?$"
# Markers that a heading's title follows.
HEADING_MARKERS = (
    r"^(?:Article|ARTICLE)[ \t]+(?:[0-9]+|[IVXLCDM]+)\.?[ \t]+(.+)$",
    r"^[0-9]+(?:\.[0-9]+){0,5}\.?[ \t]+(.+)$",
    r"^[IVXLCDM]+\.[ \t]+(.+)$",
    r"^[A-HJ-UW-Z]\.[ \t]+(.+)$",
)
INLINE_LEADER = r"^(.*?\S)\s+(?:\.\s*){2,}$"
RESET = r"^(?:(?:Article|ARTICLE)[ \t]+(?:[0-9]+|[IVXLCDM]+)\.?(?:[ \t]|$)|(?:[0-9]+\.|[1-9][0-9]?)[ \t]+)"
ROMAN = r"^[ivxlcdm]+$"


@view("contents_texts", "contents_features")
def _(d):
    """Features with white space collapsed (``t``), case-folded (``norm``), the title after a marker and whether there is one, and the title before a leader."""
    t = f"trim({d.replace_all('text', r'\s+', ' ')})"
    bare = "case " + " ".join(f"when {d.rlike('t', p)} then {d.part('t', p, 1)}" for p in HEADING_MARKERS) + " else t end"
    marked = " or ".join(d.rlike("t", p) for p in HEADING_MARKERS)
    return f"""select doc_id, seq, page, role, layer, t, lower(t) as norm, lower(trim({bare})) as title, {marked} as marked, lower(trim({d.part('t', INLINE_LEADER, 1)})) as before_leader
      from (select doc_id, seq, page, role, layer, {t} as t from contents_features)"""


@view("contents_starts", "contents_texts")
def _(d):
    """Headings of the body that open a table of contents, with the next one."""
    return f"select doc_id, seq, page, norm, lead(seq) over (partition by doc_id order by seq) as next_start from contents_texts where role = 'section_header' and layer = 'body' and {d.rlike('norm', TOC_START)}"


@view("contents_body_pages", "contents_texts")
def _(d):
    """First body item on each page, and the heading that begins the numbering anew beside other content, if the page has both."""
    content = "layer = 'body' and role <> 'section_header' and t <> ''"
    return f"""select doc_id, page, min(case when layer = 'body' then seq end) as first_body, max(case when layer = 'body' and role = 'section_header' and {d.rlike('t', RESET)} then 1 else 0 end) * max(case when {content} then 1 else 0 end) = 1 as resets
      from contents_texts group by doc_id, page"""


@view("contents_anchors", "contents_starts", "contents_outline")
def _(d):
    """Starts with the outline entries of their title and page: how many, and for a single one the pages of its next sibling and of what follows its parent's subtree."""
    return """select s.doc_id, s.seq, count(o.position) as n, max(o.position) as position, max(o.parent) as parent, max(p.depth) as parent_depth from contents_starts s
      left join contents_outline o on o.doc_id = s.doc_id and o.title = s.norm and o.page = s.page left join contents_outline p on p.doc_id = o.doc_id and p.position = o.parent group by s.doc_id, s.seq"""


@view("contents_outline_ends", "contents_anchors", "contents_outline")
def _(d):
    """Of starts with one outline entry: the least page of its later siblings, and the page of the first entry after its parent that is not below it."""
    return """select a.doc_id, a.seq, min(case when o.position > a.position and (o.parent = a.parent or o.parent is null and a.parent is null) then o.page end) as sibling_page,
        min_by(case when o.position > a.parent and o.depth <= a.parent_depth then o.page end, case when o.position > a.parent and o.depth <= a.parent_depth then o.position end) as subtree_page
      from contents_anchors a join contents_outline o on o.doc_id = a.doc_id where a.n = 1 group by a.doc_id, a.seq"""


@view("contents_reset_pages", "contents_starts", "contents_body_pages", "printed_pages")
def _(d):
    """Of starts on pages with Roman numbers: the first later page numbered 1 on which numbering begins anew."""
    return f"""select s.doc_id, s.seq, min(b.page) as page from contents_starts s join printed_pages l on l.doc_id = s.doc_id and l.page = s.page and {d.rlike('l.label', ROMAN)}
      join printed_pages one on one.doc_id = s.doc_id and one.label = '1' and one.page > s.page join contents_body_pages b on b.doc_id = one.doc_id and b.page = one.page and b.resets group by s.doc_id, s.seq"""


@view("contents_repeats", "contents_starts", "contents_texts")
def _(d):
    """Of starts: the page of the first later body heading with content after it on its page and a title that a row before the next start has (after a marker or before a leader)."""
    after = "partition by doc_id, page order by seq rows between 1 following and unbounded following"
    segment = f"{d.last('case when start_ then seq end', 'partition by doc_id order by seq rows between unbounded preceding and 1 preceding')}"
    start = f"role = 'section_header' and layer = 'body' and {d.rlike('norm', TOC_START)}"
    event = "case when role = 'section_header' then 'heading' when layer = 'body' and t <> '' then 'content' end"
    return f"""select p.doc_id, p.seq, min_by(h.page, h.seq) as page from (
        select distinct doc_id, {segment} as seq, title from (select doc_id, seq, role, {start} as start_, case when marked then title else before_leader end as title from contents_texts
          union all select doc_id, seq, role, {start} as start_, before_leader from contents_texts where marked)) p
      join (select doc_id, seq, page, title from (select doc_id, seq, page, role, layer, title, {d.first(event, after)} as follows from contents_texts) where role = 'section_header' and layer = 'body' and follows = 'content') h
        on h.doc_id = p.doc_id and h.title = p.title and h.seq > p.seq where p.title <> '' group by p.doc_id, p.seq"""


@view("contents_ends", "contents_starts", "contents_anchors", "contents_outline_ends", "contents_reset_pages", "contents_repeats", "contents_body_pages", "contents_texts")
def _(d):
    """Every start with the item before which its contents end, and before which their headings are to be looked for.

    With one outline entry of its title and page: the first body item from the page of the next sibling on. Without: from
    the page numbered 1 where numbering begins anew, if the start's page has a Roman number; else from the page of the first
    heading that repeats a row. Two outline entries, no sibling, or no end at all are states of their own, without an end.
    """
    return """select x.doc_id, x.seq as start_seq, min(case when b.page >= x.end_page then b.first_body end) as end_seq, x.rule, coalesce(min(case when b.page >= x.subtree_page then b.first_body end), max(x.last_seq) + 1) as candidate_end
      from (select s.doc_id, s.seq, case when a.n > 1 then null when a.n = 1 then o.sibling_page else coalesce(r.page, h.page) end as end_page, o.subtree_page, z.last_seq,
          case when a.n > 1 then 'ambiguous_outline' when a.n = 1 and o.sibling_page is null then 'no_later_sibling' when a.n = 1 then 'outline_sibling' when r.page is not null then 'page_reset' when h.page is not null then 'heading_repeat' else 'unterminated' end as rule
        from contents_starts s join contents_anchors a on a.doc_id = s.doc_id and a.seq = s.seq left join contents_outline_ends o on o.doc_id = s.doc_id and o.seq = s.seq left join contents_reset_pages r on r.doc_id = s.doc_id and r.seq = s.seq
          left join contents_repeats h on h.doc_id = s.doc_id and h.seq = s.seq join (select doc_id, max(seq) as last_seq from contents_texts group by doc_id) z on z.doc_id = s.doc_id) x
        left join contents_body_pages b on b.doc_id = x.doc_id group by x.doc_id, x.seq, x.rule"""


@view("contents_kept", "contents_ends")
def _(d):
    """Starts with an end that lie in no earlier region."""
    return d.disjoint("(select doc_id, start_seq, end_seq, candidate_end, rule from contents_ends where end_seq is not null and end_seq > start_seq)", "doc_id", {"start_seq": "bigint", "end_seq": "bigint", "candidate_end": "bigint", "rule": "string"})


@view("toc_regions", "contents_kept")
def _(d):
    """Regions of contents from their start to their last item."""
    return "select doc_id, start_seq, end_seq - 1 as end_seq from contents_kept"


@operator("grf09_toc_regions", "contents_ends", "contents_kept")
def _(d):
    """Starts of contents that lie in no earlier region: their region, the end of the headings it may refer to, and the rule that ended it or the reason why none did."""
    return """select e.doc_id, e.start_seq, k.end_seq, k.candidate_end, e.rule from contents_ends e left join contents_kept k on k.doc_id = e.doc_id and k.start_seq = e.start_seq
      where k.start_seq is not null or not exists (select 1 from contents_kept o where o.doc_id = e.doc_id and e.start_seq > o.start_seq and e.start_seq < o.end_seq)"""


@view("contents_items", "contents_texts", "contents_features", "contents_kept")
def _(d):
    """Body items of each region after its start, with their boxes."""
    return """select t.doc_id, k.start_seq, t.seq, t.page, t.role, t.t as text, f.l, f.r, f.b from contents_texts t join contents_kept k on k.doc_id = t.doc_id and t.seq > k.start_seq and t.seq < k.end_seq
      join contents_features f on f.doc_id = t.doc_id and f.seq = t.seq where t.layer = 'body'"""


# What a row of contents may consist of, and bounds of a period that belongs to the marker before it.
ROW_MARKER = re.compile(r"(?:(?:Article|ARTICLE) [0-9IVXLCDM]+\.?|[0-9]+(?:\.[0-9]+){0,5}\.?|Appendix [A-Z])")
NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+){0,5}\.?")
APPENDIX = re.compile(r"Appendix [A-Z]")
PAGE = re.compile(r"[A-Za-z]?[0-9]+(?:-[0-9]+)?")
LEADER = re.compile(r"\.+")
ENDS_IN_DIGITS = re.compile(r"\S[0-9]+$")
GAP, BASELINE = 3.0, 1.0
CONTINUED = "table of contents (continued)"
ROWS = "doc_id bigint, start_seq bigint, entry_no bigint, marker string, title string, printed_page string, depth bigint, state string, source_seqs array<bigint>"


def _kinds(items: list) -> list[str]:
    """What each item can be: heading, period, leader, page and marker at once (a bare number), marker, inline (a title with a leader), title."""
    out = []
    for k, x in enumerate(items):
        before = items[k - 1] if k else None
        if x.role == "section_header":
            kind = "heading"
        elif x.text == "." and before is not None and NUMBER.fullmatch(before.text) and not before.text.endswith(".") and before.page == x.page and before.seq + 1 == x.seq and 0 <= x.l - before.r <= GAP and abs(x.b - before.b) <= BASELINE:
            kind = "period"
        elif LEADER.fullmatch(x.text):
            kind = "leader"
        elif PAGE.fullmatch(x.text):
            kind = "number" if ROW_MARKER.fullmatch(x.text) else "page"
        elif ROW_MARKER.fullmatch(x.text):
            kind = "marker"
        else:
            kind = "inline" if re.search(INLINE_LEADER, x.text) else "title"
        out.append(kind)
    return out


def _titled(items: list, kinds: list[str]) -> list[bool]:
    """Whether a marker at each place would have a title ahead: something that is a title, then a leader; markers that are no
    plain numbers also take the next marker or the end of the region for one, and appendices a heading. One pass from the end."""
    out = [False] * len(items)
    # what comes after a place: whether a title stands before the thing that decides, and that thing
    titles, decides = False, "end"
    for k in range(len(items) - 1, -1, -1):
        follows, by = (titles, decides)
        if k + 1 < len(items) and kinds[k + 1] == "period":
            follows, by = after_period
        number, appendix = NUMBER.fullmatch(items[k].text), APPENDIX.fullmatch(items[k].text)
        out[k] = follows and (by == "leader" or by == "heading" and bool(appendix) or by in ("marker", "end") and not number)
        after_period = (titles, decides)
        if kinds[k] == "heading":
            # a heading that reads as a leader, a page or a marker decides as such
            text = items[k].text
            titles, decides = False, "leader" if LEADER.fullmatch(text) else "page" if PAGE.fullmatch(text) else "marker" if ROW_MARKER.fullmatch(text) else "heading"
        elif kinds[k] in ("leader", "period"):
            titles, decides = False, "leader"
        elif kinds[k] in ("number", "page"):
            titles, decides = False, "page"
        elif kinds[k] == "marker":
            titles, decides = False, "marker"
        else:
            titles = True
    return out


def rows_of(items: list) -> Iterator[tuple[str | None, str | None, str | None, str, list[int]]]:
    """Marker, title, printed page, state and items of each row; rejected items have the reason as their state and no title.

    ``items``: of one region in order, with seq, page, role, text (white space collapsed), l, r and b.
    """
    kinds = _kinds(items)
    titled = _titled(items, kinds)
    row: list = []
    marker, titles, leading = None, [], False

    def closed(page: str | None):
        nonlocal row, marker, titles, leading
        reason = None
        if not titles:
            reason = "no title"
        elif marker is None and page is None and not leading:
            reason = "neither marker nor page"
        elif not (marker and APPENDIX.fullmatch(marker)) and any(ENDS_IN_DIGITS.search(x.text) for x in titles):
            reason = "digits at the end of a title"
        if reason:
            return rejected(reason)
        parts = [m[1] if (m := re.search(INLINE_LEADER, x.text)) else x.text for x in titles]
        out = (marker, " ".join(parts).lower(), page, "complete" if page is not None else "missing_printed_page", [x.seq for x in row])
        row, marker, titles, leading = [], None, [], False
        return out

    def rejected(reason: str):
        nonlocal row, marker, titles, leading
        out = (None, None, None, reason, [x.seq for x in row])
        row, marker, titles, leading = [], None, [], False
        return out

    for k, x in enumerate(items):
        kind = kinds[k]
        if kind == "heading":
            if x.text.lower() == CONTINUED:
                if row:
                    yield rejected("a continued heading interrupts the row")
                continue
            if row:
                yield closed(None)
            if APPENDIX.fullmatch(x.text):
                row, marker = [x], x.text
            else:
                row = [x]
                yield rejected("unexpected heading")
            continue
        if kind == "period" and marker is not None and not titles and row and row[-1] is items[k - 1]:
            row.append(x)
            marker += "."
            continue
        kind = "leader" if kind == "period" else kind
        is_page = kind in ("number", "page")
        is_marker = kind in ("number", "marker") and titled[k] and not (row and leading and is_page)
        if not row:
            row = [x]
            if is_marker:
                marker = x.text
            elif kind == "inline":
                titles, leading = [x], True
            elif kind == "leader" or is_page:
                yield rejected("neither marker nor title at the start")
            else:
                titles = [x]
        elif leading:
            row.append(x)
            if is_page:
                yield closed(x.text)
            elif kind != "leader":
                yield rejected("no page after the leader")
        elif is_marker:
            yield closed(None)
            row, marker = [x], x.text
        elif kind == "leader":
            row.append(x)
            leading = True
        elif kind == "inline":
            row.append(x)
            titles.append(x)
            leading = True
        elif is_page:
            row.append(x)
            yield rejected("a page before the leader")
        else:
            row.append(x)
            titles.append(x)
    if row:
        yield closed(None)


def parse_rows(items: DataFrame) -> DataFrame:
    """Rows of contents of regions (doc_id, start_seq, seq, page, role, text, l, r, b), numbered from 1, and rejected items.

    The depth is that of the marker's number, else 1; nulls are empty texts, and empty texts are titles of nothing: they are
    left out. A region is worked off in one task; it is as long as one table of contents.
    """
    ship(items.sparkSession)

    def run(region: pd.DataFrame) -> pd.DataFrame:
        region = region.assign(text=region.text.fillna("").str.replace(r"\s+", " ", regex=True).str.strip())
        ordered = list(region[region.text != ""].sort_values("seq").itertuples(index=False))
        found = [
            (region.doc_id.iloc[0], region.start_seq.iloc[0], k, marker, title, page, None if title is None else marker.rstrip(".").count(".") + 1 if marker and NUMBER.fullmatch(marker) else 1, state, seqs)
            for k, (marker, title, page, state, seqs) in enumerate(rows_of(ordered), 1)
        ]
        return pd.DataFrame(found, columns=[x.split()[0] for x in ROWS.split(", ")])

    return items.groupBy("doc_id", "start_seq").applyInPandas(run, ROWS)

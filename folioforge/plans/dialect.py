"""Spellings that differ between Spark SQL and the SQL of the checking engine. Operators are written once against these."""

from __future__ import annotations


class Spark:
    name = "spark"

    def __init__(self, parts: int | None = None):
        self.parts = parts

    def dealt(self, relation: str, *keys: str) -> str:
        """``relation`` dealt by ``keys`` in as many parts as the tables that the statement is over (``parts``), if they are dealt."""
        return f"(select /*+ repartition({self.parts}, {', '.join(keys)}) */ * from {relation})" if self.parts else relation

    def re(self, pattern: str) -> str:
        """A pattern as a literal that keeps its backslashes (it may hold one kind of quotes)."""
        return f"r'{pattern}'" if '"' in pattern else f'r"{pattern}"'

    def rlike(self, text: str, pattern: str) -> str:
        return f"rlike({text}, {self.re(pattern)})"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, '{by}')"

    def part(self, text: str, pattern: str, group: int) -> str:
        """A group of the first match; empty where there is none."""
        return f"regexp_extract({text}, {self.re(pattern)}, {group})"

    def last_part(self, text: str, pattern: str, group: int) -> str:
        """A group of the last match; empty where there is none."""
        return f"coalesce(element_at(regexp_extract_all({text}, {self.re(pattern)}, {group}), -1), '')"

    def spans(self, relation: str, text: str, pattern: str) -> str:
        """``relation`` with one row for each match: ``raw`` and the code points before it in ``at_``. One scan, one pass over the text."""
        p = self.re(pattern)
        ends = "aggregate(slice({0}, 1, i{1}), 0, (a, x) -> a + length(x))"
        each = f"transform(found, (m, i) -> named_struct('raw', m, 'at_', {ends.format('pieces', ' + 1')} + {ends.format('found', '')}))"
        return f"(select * from (select *, regexp_extract_all({text}, {p}, 0) as found, split({text}, {p}, -1) as pieces from {relation} where {self.rlike(text, pattern)}) lateral view inline({each}) x as raw, at_)"

    def exploded(self, relation: str, name: str, *values: str) -> str:
        """``relation`` with one row for each of the structs ``values`` (alternatives of fields, as ``field: expression`` pairs)."""
        return f"(select * from (select *, explode(array({', '.join(values)})) as {name} from {relation}))"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def max_delta(self, a: str, b: str) -> str:
        """Greatest difference of two lists of numbers place by place; null where their lengths differ."""
        return f"case when size({a}) = size({b}) then array_max(zip_with({a}, {b}, (x, y) -> abs(x - y))) end"

    def row(self, *values: str) -> str:
        """Values to be compared one after another."""
        return self.struct(**{f"k{i}": v for i, v in enumerate(values)})

    def padded_id(self, prefix: str, number: str) -> str:
        """``prefix`` and the number with six digits at least."""
        return f"{prefix} || lpad(cast({number} as string), cast(greatest(6, length(cast({number} as string))) as int), '0')"

    def listagg(self, value: str, order: str, sep: str = ",") -> str:
        return f"listagg({value}, '{sep}') within group (order by {order})"

    def last(self, value: str, over: str) -> str:
        return f"last_value({value}) ignore nulls over ({over})"

    def first(self, value: str, over: str) -> str:
        return f"first_value({value}) ignore nulls over ({over})"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def series(self, relation: str, name: str, lo: str, hi: str) -> str:
        """``relation`` with one row for each integer ``name`` from lo to hi."""
        return f"(select *, explode(sequence(cast({lo} as bigint), cast({hi} as bigint))) as {name} from {relation} where {lo} <= {hi})"

    def words(self, relation: str, column: str, name: str, sep: str = " ") -> str:
        """``relation`` with one row for each piece of ``column``."""
        return f"(select *, explode(split({column}, '{sep}')) as {name} from {relation})"

    def matches(self, relation: str, text: str, pattern: str, group: int, name: str) -> str:
        """``relation`` with one row for each match, numbered from 1 in ``position``."""
        return f"(select *, position + 1 as position_1 from {relation} lateral view posexplode(regexp_extract_all({text}, {self.re(pattern)}, {group})) x as position, {name})"

    def disjoint(self, relation: str, key: str, columns: dict[str, str]) -> str:
        """Of the spans of ``relation`` (start_seq, end_seq excluded) under each key, in order, those that begin in none kept before."""
        kept = "array<struct<" + ", ".join(f"{c}: {t}" for c, t in columns.items()) + ">>"
        fold = f"aggregate(spans, named_struct('upto', cast(-1 as bigint), 'kept', cast(array() as {kept})), (a, x) -> case when x.start_seq >= a.upto then named_struct('upto', x.end_seq, 'kept', concat(a.kept, array(x))) else a end, a -> a.kept)"
        return f"select {key}, {', '.join(columns)} from (select {key}, inline({fold}) from (select {key}, array_sort(collect_list(struct({', '.join(columns)}))) as spans from {relation} group by {key}))"

    def split_lines(self) -> str:
        return "select doc_id, cast(pos as bigint) as seq, line from documents lateral view posexplode(split(text, '\\n')) t as pos, line"

    def try_int(self, text: str) -> str:
        return f"try_cast({text} as bigint)"

    def text_list(self, *values: str) -> str:
        return f"array({', '.join(values)})"

    def date(self, text: str) -> str:
        return f"cast({text} as date)"


class DuckDB(Spark):
    name = "duckdb"

    def re(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def rlike(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.re(pattern)})"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, '{by}', 'g')"

    def last_part(self, text: str, pattern: str, group: int) -> str:
        return f"coalesce(regexp_extract_all({text}, {self.re(pattern)}, {group})[-1], '')"

    def spans(self, relation: str, text: str, pattern: str) -> str:
        p = self.re(pattern)
        found = f"select *, regexp_extract_all({text}, {p}) as found, string_split_regex({text}, {p}) as pieces from {relation} where {self.rlike(text, pattern)}"
        at = "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
        return f"(select *, found[i] as raw, {at} as at_ from (select *, unnest(range(1, len(found) + 1)) as i from ({found})))"

    def exploded(self, relation: str, name: str, *values: str) -> str:
        return f"(select *, unnest([{', '.join(values)}]) as {name} from {relation})"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def max_delta(self, a: str, b: str) -> str:
        return f"case when len({a}) = len({b}) then list_max(list_transform(list_zip({a}, {b}), lambda x: abs(x[1] - x[2]))) end"

    def listagg(self, value: str, order: str, sep: str = ",") -> str:
        return f"string_agg({value}, '{sep}' order by {order})"

    def last(self, value: str, over: str) -> str:
        return f"last_value({value} ignore nulls) over ({over})"

    def first(self, value: str, over: str) -> str:
        return f"first_value({value} ignore nulls) over ({over})"

    def sha256(self, text: str) -> str:
        return f"sha256({text})"

    def series(self, relation: str, name: str, lo: str, hi: str) -> str:
        return f"(select *, unnest(range(cast({lo} as bigint), cast({hi} as bigint) + 1)) as {name} from {relation} where {lo} <= {hi})"

    def words(self, relation: str, column: str, name: str, sep: str = " ") -> str:
        return f"(select *, unnest(string_split({column}, '{sep}')) as {name} from {relation})"

    def matches(self, relation: str, text: str, pattern: str, group: int, name: str) -> str:
        return f"(select *, unnest(range(1, len(found) + 1)) as position_1, unnest(found) as {name} from (select *, regexp_extract_all({text}, {self.re(pattern)}, {group}) as found from {relation}))"

    def disjoint(self, relation: str, key: str, columns: dict[str, str]) -> str:
        names = ", ".join(columns)
        return f"""select {key}, {names} from (with recursive ordered as (select *, row_number() over (partition by {key} order by start_seq) as k_ from {relation}),
          walk as (select {key}, k_, end_seq as upto, true as taken from ordered where k_ = 1 union all select o.{key}, o.k_, case when o.start_seq >= w.upto then o.end_seq else w.upto end, o.start_seq >= w.upto from walk w join ordered o on o.{key} = w.{key} and o.k_ = w.k_ + 1)
          select o.* from ordered o join walk w on w.{key} = o.{key} and w.k_ = o.k_ where w.taken)"""

    def split_lines(self) -> str:
        return "select doc_id, cast(unnest(range(len(p))) as bigint) as seq, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)"

    def text_list(self, *values: str) -> str:
        return f"[{', '.join(values)}]"


SPARK, DUCKDB = Spark(), DuckDB()

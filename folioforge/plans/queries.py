"""Every operator as a query over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import folioforge.functions.scalars
import folioforge.operators.aggregates
import folioforge.operators.checks
import folioforge.operators.contents
import folioforge.operators.graphs
import folioforge.operators.hierarchy
import folioforge.operators.joins
import folioforge.operators.lifecycle
import folioforge.operators.ordering
import folioforge.operators.predicates
import folioforge.operators.windows
import folioforge.sources.bundles
import folioforge.sources.fixtures  # noqa: F401
from folioforge.executors import beside, kept, kept_dealt
from folioforge.functions.text import multiset_digest, normalized, table_text
from folioforge.operators import contents, hierarchy, records, sequential, trees
from folioforge.plans.catalog import OPERATORS, needs, operator, oracle, over_folder, parts_for, query, relations


@operator("flagship_reference_resolution", "local_resolution")
def _(d):
    """Which references documents make and how they resolve."""
    return "select mention_class, status, coalesce(reason, '-') as reason, count(*) as n from local_resolution group by mention_class, status, coalesce(reason, '-')"


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture relation as a frame."""
    return over_folder(spark, sf_dir, name)


def scl03_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell texts in compatibility form."""
    return _view(spark, sf_dir, "items").select("doc_id", "seq", table_text(F.col("mtext")).alias("text"))


def scl01_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in normal form with white space collapsed and, beside it, case-folded."""
    lines = _view(spark, sf_dir, "lines")
    return lines.select("doc_id", "seq", normalized(F.col("line")).alias("normalized"), normalized(F.col("line"), fold=True).alias("folded"))


def scl02_alias_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias spellings in their lookup form."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("source_id"), normalized(F.col("n_name"), fold=True).alias("normalized_alias"))


def grf01_preorder_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in pre-order."""
    return trees.preorder(_view(spark, sf_dir, "tree"))


def grf01_record_traversal(caller: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents in reading order: texts, tables, figures and captions once, furniture last; documents that cannot be put in order as violations."""
    spark = beside(caller, IN_PARTS)
    documents, parts = _documents(spark, sf_dir)
    items = over_folder(spark, sf_dir, "items", documents=documents).select("doc_id", "seq", "page", "layer")
    items = kept_dealt(items, "items", parts, "doc_id", "seq")
    return kept(records.traverse(*(over_folder(spark, sf_dir, name, items=items) for name in ("record_nodes", "record_edges")), parts), "records", caller)


def grf02_feature_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached from a root by label, and those that are not."""
    tree = _view(spark, sf_dir, "section_tree")
    found = trees.path_sums(tree).join(tree.select("id", "label"), "id")
    return found.groupBy("label").agg(F.count("root").alias("reached"), F.count(F.when(F.col("root").isNull(), 1)).alias("unreached"))


def grf03_descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of the nodes one level below the root: what has one of them for its root once the root is taken away."""
    tree = _view(spark, sf_dir, "tree").where("parent_id is not null")
    below = tree.select("id", F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent_id"))
    return trees.path_sums(below).groupBy(F.col("root").alias("top")).agg((F.count("*") - 1).alias("descendants"), F.max("id").alias("last_id"))


def grf04_outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries with their level counted from the root, up to the deepest that a heading may have."""
    levels = trees.path_sums(_view(spark, sf_dir, "tree"), level=F.lit(1))
    return levels.select("id", F.least(F.col("level"), F.lit(MAX_LEVEL)).cast("bigint").alias("effective_level"))


def grf05_retained_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest heading above that is retained."""
    return trees.nearest_kept(_view(spark, sf_dir, "heading_tree"), ~F.col("replaced"))


def flt03_structural_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in a bibliography section or below one, with the number of such sections at or above them."""
    marked = _view(spark, sf_dir, "bibliography_sections").select("id", F.lit(1).alias("mark"))
    sums = trees.path_sums(_view(spark, sf_dir, "tree").join(marked, "id", "left"), times=F.coalesce("mark", F.lit(0)))
    return sums.where("times > 0").select("id", "times")


def val02_section_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and root of every section; null where it is on a cycle or below one."""
    return trees.path_sums(_view(spark, sf_dir, "section_tree"), steps=F.lit(1)).select("id", (F.col("steps") - 1).alias("depth"), "root")


def agg24_multiset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent digest of the documents."""
    return multiset_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def srt06_distinct_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes without near duplicates, by record."""
    boxes = _view(spark, sf_dir, "boxes").where("page_known").select(F.col("box_id").cast("bigint").alias("page"), F.col("box_id").cast("bigint").alias("box_id"), F.col("part_no").cast("int").alias("part_no"), "l", "b", "r", "t")
    return sequential.distinct_boxes(boxes)


def jn16_region_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a record with their tables, one to one."""
    boxes = _view(spark, sf_dir, "region_pairs")
    return sequential.match_regions(boxes.where("is_region").drop("is_region"), boxes.where("not is_region").drop("is_region"))


def grf06_table_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of tables by evidence, the stronger kinds first."""
    order = F.array_position(F.array(*map(F.lit, EVIDENCE)), F.col("evidence"))
    return sequential.table_families(_view(spark, sf_dir, "family_edges").select("doc_id", "a", "b", order.alias("rank")), _view(spark, sf_dir, "family_tables"))


def grf10_grid_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topology of token grids derived from table rows."""
    token = "case when l_partkey % 7 = 0 then 'lcel' when l_suppkey % 5 = 0 and r > 1 then 'ucel' else 'fcel' end"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")))
    return sequential.grid_topology(rows.selectExpr("cast(l_orderkey as bigint) as table_id", "r", f"array('fcel', {token}, case when l_partkey % 3 = 0 then 'lcel' else 'ecel' end) as tokens"))


def grf08_toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the contents of documents, and items that are part of none with the reason."""
    return contents.parse_rows(_view(spark, sf_dir, "contents_items"))


# Relations that the rule cascade reads many times (items over 150 times), in the order in which they are written; items without the texts of references.
STAGES = {
    "items": ("doc_id", "seq", "page", "line", "role", "layer", "level", "left_pt", "in_picture", "n_regions", "ntext"),
    "parsed_numbers": (), "outline_matches": (), "toc_matches": (), "toc_targets": (), "calibrated": (), "contents_texts": (), "heading_parents": (), "contents_repeats": (), "toc_regions": (), "supported_levels": (),
}


DOCUMENTS_PER_STAGE_PART = 10_000  # documents whose relations one task derives


# Parts by some of a join's keys serve; no side of a join goes through the driver; tables are read in their parts and sorted, and unions are dealt anew (a scan below one may leave its parts).
IN_PARTS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.unionOutputPartitioning": "false",
}


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Documents dealt by id in parts of bounded size, and how many these are."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parts = max(spark.sparkContext.defaultParallelism, -(-documents.count() // DOCUMENTS_PER_STAGE_PART))
    return documents.repartition(parts, "doc_id"), parts


def _stages(spark: SparkSession, sf_dir: str, documents: DataFrame, parts: int) -> dict[str, DataFrame]:
    """Tables of the stages; each is derived from those before it. Documents are dealt once, and all tables stay in their parts."""
    frames: dict[str, DataFrame] = {}
    for name, columns in STAGES.items():
        df = over_folder(spark, sf_dir, name, **(frames or {"documents": documents}))
        frames[name] = kept_dealt(df.select(*columns) if columns else df, name, parts, "doc_id", "start_seq" if name == "toc_regions" else "seq")
    return frames


def _in_stages(name: str):
    """A query over the stages; if it needs the hierarchy, that is the pass, where its SQL has the same relation by joins.

    All relations are of one document, so joins by further keys are made in the documents' parts, too, in a session with
    settings for that (``IN_PARTS``). The result is written, so that it is the caller's session that reads it.
    """

    def run(caller: SparkSession, sf_dir: str) -> DataFrame:
        spark = beside(caller, IN_PARTS)
        documents, parts = _documents(spark, sf_dir)
        frames = _stages(spark, sf_dir, documents, parts)
        if name in OVER_HIERARCHY:
            decisions = hierarchy.decided(over_folder(spark, sf_dir, "grf12_rule_cascade", **frames))
            scopes = over_folder(spark, sf_dir, "scopes", **frames).withColumn("root_level", F.lit(hierarchy.ROOT_LEVEL))
            frames["corrected_hierarchy"] = kept_dealt(hierarchy.project(decisions, scopes, parts), "corrected_hierarchy", parts, "doc_id", "seq")
        return kept(over_folder(spark, sf_dir, name, **frames), name, caller)

    run.__name__, run.__doc__ = name, OPERATORS[name].doc
    return run


IN_ROWS = ("row_texts", "headers", "column_types")  # relations over cells that have a form in which a row's cells stay together


def _by_table(name: str):
    """A query over rows of tables: they are dealt once by table, in parts of bounded size that all its windows, groups and joins keep."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        parts = parts_for(rows)
        dealt = {"lineitem": rows.repartition(parts, "l_orderkey")}
        in_rows = {x: over_folder(spark, sf_dir, f"{x}_in_rows", parts, **dealt) for x in IN_ROWS if needs(name, x)}
        return over_folder(spark, sf_dir, name, parts, **dealt, **in_rows)

    run.__name__, run.__doc__ = name, OPERATORS[name].doc
    return run


# Columns of items that targets of references are derived from.
TARGET_COLUMNS = ("doc_id", "seq", "page", "line", "role", "layer", "level")
DOCUMENTS_PER_PART = 1_000  # documents whose texts one task searches


def _over_mentions(name: str):
    """A query over references: texts are dealt in bounded parts and searched once, and all uses read the written references and slim items."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        parts = max(spark.sparkContext.defaultParallelism, -(-documents.count() // DOCUMENTS_PER_PART))
        frames = {"mentions": kept(over_folder(spark, sf_dir, "mentions", documents=documents.select("doc_id", "text").repartition(parts, "doc_id")), "mentions")}
        if needs(name, "headings"):
            frames["items"] = kept(over_folder(spark, sf_dir, "items").select(*TARGET_COLUMNS), "items")
        return over_folder(spark, sf_dir, name, **frames)

    run.__name__, run.__doc__ = name, OPERATORS[name].doc
    return run


OVER_HIERARCHY = ("win04_corrected_hierarchy", "win06_sparse_corrected", "grf13_section_placement", "grf14_section_children")
OVER_STAGES = ("grf12_rule_cascade", "agg05_rule_summary", *OVER_HIERARCHY)
# One-to-one matching step by step: the regions of a page in order, each with its candidates best first, and the tables taken so far.
MATCHING = (
    "regions as (select *, row_number() over (partition by page order by t desc, l, b desc, id) as k from region_pairs where is_region)",
    "meeting as (select x.page, x.k, x.id as region_id, y.id, (least(x.r, y.r) - greatest(x.l, y.l)) * (least(x.t, y.t) - greatest(x.b, y.b)) as both_, (x.r - x.l) * (x.t - x.b) + (y.r - y.l) * (y.t - y.b) as sum_ from regions x left join region_pairs y on y.page = x.page and not y.is_region and least(x.r, y.r) > greatest(x.l, y.l) and least(x.t, y.t) > greatest(x.b, y.b))",
    "choices as (select page, k, region_id, list({'iou': both_ / (sum_ - both_), 'id': id} order by both_ / (sum_ - both_) desc, id) filter (where both_ / (sum_ - both_) >= 0.5) as found from meeting group by page, k, region_id)",
    "matched as (select distinct page, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(null as bigint) as region_id, cast(null as struct(iou double, id bigint)) as pick from regions union all select page, k, case when pick is null then used else list_append(used, pick.id) end, region_id, pick from (select c.page, c.k, m.used, c.region_id, list_filter(c.found, lambda x: not list_contains(m.used, x.id))[1] as pick from matched m join choices c on c.page = m.page and c.k = m.k + 1))",
)
EVIDENCE = ("continuation", "footer_run", "exact_header")  # fixed values: evidence of table families in order
MAX_LEVEL = 6  # fixed value: the deepest level of a heading
GROUPED = (
    scl01_normalize_text, scl02_alias_normalization, scl03_table_text, agg24_multiset_digest, srt06_distinct_boxes, jn16_region_matching, grf01_preorder_traversal, grf01_record_traversal, grf02_feature_traversal, grf03_descendant_closure,
    grf04_outline_levels, grf05_retained_parent, grf06_table_families, grf10_grid_topology, grf08_toc_entries, flt03_structural_exclusion, val02_section_cycles,
)
OVER_TABLE_ROWS = (*(name for name in OPERATORS if needs(name, "grid")), "jn22_region_clean_table")
OVER_MENTIONS = tuple(name for name in OPERATORS if needs(name, "mentions"))
QUERIES = {name: query(name) for name in OPERATORS} | {name: _by_table(name) for name in OVER_TABLE_ROWS} | {name: _over_mentions(name) for name in OVER_MENTIONS} | {f.__name__: f for f in GROUPED} | {name: _in_stages(name) for name in OVER_STAGES}


def _by_hand() -> dict[str, str]:
    """SQL of the checking engine for queries that are no SQL here, over relations of the same names."""
    walk = "walk as (select id, label, id as root, 0 as depth, lpad(cast(id as varchar), 19, '0') as path from {t} where parent_id is null union all select x.id, x.label, w.root, w.depth + 1, w.path || '/' || lpad(cast(x.id as varchar), 19, '0') from {t} x join walk w on x.parent_id = w.id)"
    tree, sections = walk.format(t="tree"), walk.format(t="section_tree")
    squeezed = r"trim(regexp_replace(replace(nfc_normalize({0}), chr(160), ' '), '[\s\x1C-\x1F\x0B\x{{85}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
    folded = "replace(lower({0}), 'ß', 'ss')"
    line, name = squeezed.format("line"), squeezed.format("n_name")
    return {
        "scl01_normalize_text": relations(("lines",), f"select doc_id, seq, {line} as normalized, {folded.format(line)} as folded from lines"),
        "scl02_alias_normalization": f"select n_nationkey as source_id, {folded.format(name)} as normalized_alias from nation",
        "scl03_table_text": relations(("items",), f"select doc_id, seq, {squeezed.format('mtext')} as text from items"),
        "grf01_preorder_traversal": relations(("tree",), f"select id, depth, row_number() over (order by path) as position from walk", tree),
        "grf02_feature_traversal": relations(("section_tree",), "select t.label, count(w.id) as reached, count(*) - count(w.id) as unreached from section_tree t left join walk w on w.id = t.id group by t.label", sections),
        "grf03_descendant_closure": relations(("tree",), "select top, count(*) - 1 as descendants, max(id) as last_id from below group by top", "below as (select id as top, id from tree where parent_id = 0 union all select b.top, t.id from tree t join below b on t.parent_id = b.id)"),
        "grf04_outline_levels": relations(("tree",), f"select id, least({MAX_LEVEL}, depth + 1) as effective_level from walk", tree),
        "grf05_retained_parent": relations(("heading_tree",), "select u.id, max(case when h.id is not null and not h.replaced then u.at_ end) as parent_id from up u left join heading_tree h on h.id = u.at_ group by u.id", "up as (select id, parent_id as at_ from heading_tree where not replaced union all select u.id, h.parent_id from up u join heading_tree h on h.id = u.at_ where h.replaced)"),
        "flt03_structural_exclusion": relations(("tree", "bibliography_sections"), "select id, count(*) as times from below group by id", "below as (select id from bibliography_sections union all select t.id from tree t join below b on t.parent_id = b.id)"),
        "val02_section_cycles": relations(("section_tree",), "select t.id, w.depth, w.root from section_tree t left join walk w on w.id = t.id", sections),
        "jn16_region_matching": relations(("region_pairs",), "select page, region_id, pick.id as table_id, pick.iou as iou from matched where pick is not null", *MATCHING),
    }


def oracles() -> dict[str, str]:
    return {name: oracle(name) for name in OPERATORS} | _by_hand()

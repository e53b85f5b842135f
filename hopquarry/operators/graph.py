"""The bipartite graph of entities (or terms) and documents, as an edge frame.

Nodes are numbers: a document is its ``doc_idx``, an entity ``-1 - ent_idx``,
where entities are numbered in order of their first mention.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..functions.text import TO_TOKENS, extract_entities, tokenize
from ..storage import stored
from . import walk
from .linking import apply_alias_map
from .tagging import Tagger, tagged_entities

NORMALIZATIONS = ("row", "sym", "none")


@dataclass
class Graph:
    """``entities`` (entity, df, ent_idx), ``edges`` (src, dst, p), ``docs`` (doc_idx); ``pairs`` are undirected edges.

    ``items`` (doc_idx, items: array of entity and tf) are the mentions by documents, or they are counted in
    ``chunks`` already, with ``found`` of these.  Edges and ``blocks`` of pairs are made and stored when they are first used.
    """

    entities: DataFrame
    docs: DataFrame
    pairs: DataFrame
    items: DataFrame | None
    normalization: str = "row"
    hub_penalty: float = 0.0
    edge_cap: int | None = None
    chunks: DataFrame | None = None
    found: DataFrame | None = None

    @cached_property
    def edges(self) -> DataFrame:
        return stored(transition(self.pairs, self.normalization), "edges")

    @property
    def has_blocks(self) -> bool:
        """Blocks hold ``tf`` and factors of both ends, as all rows of all pairs have them."""
        return self.normalization == "row" and not (self.edge_cap and self.edge_cap > 0)

    @cached_property
    def blocks(self) -> walk.Blocks:
        chunks = stored(walk.chunks_of_items(self.items), "chunks") if self.chunks is None else self.chunks
        return walk.build_blocks(chunks, self.entities, self.docs, self.hub_penalty, self.found)


def mentions(docs: DataFrame, aliases: DataFrame | None = None, mode: str = "none", min_len: int = 2, ner: Callable[[], Tagger] | None = None) -> DataFrame:
    """``doc_idx, entity, tf, pos``: how often a document mentions an entity, and where first; ``ner`` loads a tagger."""
    names = extract_entities(F.col("text"), dedup=False) if ner is None else tagged_entities(F.col("text"), ner, dedup=False)
    found = docs.select("doc_idx", F.posexplode(names).alias("pos", "entity"))
    linked = apply_alias_map(found, aliases, mode).where(F.char_length("entity") >= min_len)
    return linked.groupBy("doc_idx", "entity").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))


def term_mentions(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_idx", F.posexplode(tokenize(F.col("text"))).alias("pos", "entity"))
    return found.groupBy("doc_idx", "entity").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in this order: sorted ranges, each shifted by the sizes of those before.

    The ranges are stored before they are counted, so that both uses see the same cuts.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    sizes = ranged.groupBy("part").count()
    shift = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("place", place).join(F.broadcast(sizes.select("part", shift.alias("shift"))), "part").withColumn(name, F.col("place") + F.col("shift")).drop("part", "place", "shift")


def without_hubs(table: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The rows of an entity table without its most frequent share, and that share: places by ranges, not one sorted task."""
    placed = numbered(table.withColumn("_neg", -F.col("df")), ["_neg", "first_doc", "first_pos"], "_place").drop("_neg")
    size = table.agg(F.floor(F.count("*") * min(1.0, max(0.0, float(share)))).alias("_cut"))
    cut = placed.crossJoin(F.broadcast(size))
    kept, hubs = cut.where("_place >= _cut"), cut.where("_place < _cut")
    return kept.drop("_place", "_cut"), hubs.drop("_place", "_cut")


def entity_table(found: DataFrame, docs: DataFrame, min_df: int = 1, max_df_ratio: float = 1.0, hub_top_ratio: float = 0.0) -> DataFrame:
    """Entities whose document frequency lies in the window, without the most frequent share."""
    table = found.groupBy("entity").agg(F.count("*").alias("df"), F.min(F.struct("doc_idx", "pos")).alias("first"))
    return _within(table, docs, min_df, max_df_ratio, hub_top_ratio)


def _within(table: DataFrame, docs: DataFrame, min_df: int, max_df_ratio: float, hub_top_ratio: float = 0.0) -> DataFrame:
    """``entity_table`` from ``entity, df, first``."""
    bound = docs.agg(F.greatest(F.lit(1), F.floor(max_df_ratio * F.greatest(F.lit(1), F.count("*")))).alias("most"))
    table = table.crossJoin(F.broadcast(bound)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("most"))).drop("most")
    table = table.select("entity", "df", F.col("first.doc_idx").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    if hub_top_ratio > 0:
        table = without_hubs(table, hub_top_ratio)[0]
    return numbered(table, ["first_doc", "first_pos"], "ent_idx").select("entity", "df", "ent_idx")


def weighted_pairs(found: DataFrame, entities: DataFrame, docs: DataFrame, hub_penalty: float = 0.0, edge_cap: int | None = None) -> DataFrame:
    """``ent_idx, doc_idx, w, back``: the weight from entity to document, and that of the way back."""
    n = docs.agg(F.greatest(F.lit(1), F.count("*")).cast("double").alias("n"))
    pairs = found.join(entities, "entity").crossJoin(F.broadcast(n))
    weight = F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    back = F.pow(F.col("df") + F.lit(1e-9), F.lit(-hub_penalty)) if hub_penalty > 0 else F.lit(1.0)
    pairs = pairs.select("ent_idx", "doc_idx", weight.alias("w"), (weight * back).alias("back"))
    if edge_cap and edge_cap > 0:
        best = Window.partitionBy("ent_idx").orderBy(F.round("w", 9).desc(), "doc_idx")
        pairs = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= edge_cap).drop("place")
    return pairs


def transition(pairs: DataFrame, normalization: str = "row") -> DataFrame:
    """``src, dst, p`` both ways; ``sym`` divides by the roots of both degrees first, and then also by rows."""
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization: {normalization}")
    entity = (-1 - F.col("ent_idx")).alias("node")
    ways = pairs.select(F.explode(F.array(F.struct(entity.alias("src"), F.col("doc_idx").alias("dst"), F.col("w").alias("p")), F.struct(F.col("doc_idx").alias("src"), entity.alias("dst"), F.col("back").alias("p")))).alias("e")).select("e.*")
    if normalization == "none":
        return ways
    if normalization == "sym":
        degree = ways.groupBy("src").agg(F.sum("p").alias("deg")).where("deg != 0")
        root = lambda c: 1 / F.sqrt(F.coalesce(F.col(c), F.lit(1.0)))
        ways = ways.join(degree.withColumnRenamed("deg", "from_deg"), "src", "left")
        ways = ways.join(degree.select(F.col("src").alias("dst"), F.col("deg").alias("to_deg")), "dst", "left")
        ways = ways.select("src", "dst", (F.col("p") * root("from_deg") * root("to_deg")).alias("p"))
    total = F.sum("p").over(Window.partitionBy("src"))
    return ways.select("src", "dst", F.when(total != 0, F.col("p") / total).otherwise(F.col("p")).alias("p"))


def build_graph(
    docs: DataFrame, aliases: DataFrame | None = None, mode: str = "none", min_len: int = 2, min_df: int = 1, max_df_ratio: float = 1.0,
    hub_penalty: float = 0.0, hub_top_ratio: float = 0.0, edge_cap: int | None = None, normalization: str = "row", ner: Callable[[], Tagger] | None = None,
) -> Graph:
    """Mentions and entities are stored, so texts are read once."""
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization: {normalization}")
    found = stored(mentions(docs, aliases, mode, min_len, ner), "mentions")
    entities = stored(entity_table(found, docs, min_df, max_df_ratio, hub_top_ratio), "entities")
    pairs = weighted_pairs(found, entities, docs, hub_penalty, edge_cap)
    items = found.groupBy("doc_idx").agg(F.collect_list(F.struct("entity", "tf")).alias("items"))
    return Graph(entities, docs.select("doc_idx"), pairs, items, normalization, hub_penalty, edge_cap)


def counted_terms(docs: DataFrame) -> DataFrame:
    """Chunks of each row's terms with their counts, in order of their first places; counted where the text is read."""
    most = walk.BLOCK_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = walk.Chunks(most)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter((text or b"").translate(TO_TOKENS).split())
                chunks.add(doc, counts.keys(), counts.values())
                if chunks.full():
                    yield from chunks.take()
        yield from chunks.take()

    ship_code(docs.sparkSession)
    return docs.select(F.col("doc_idx").cast("long").alias("doc_idx"), F.col("text").cast("binary").alias("text")).mapInArrow(run, walk.CHUNK)


def build_term_graph(docs: DataFrame, min_df: int = 5, max_df_ratio: float = 0.2, normalization: str = "row") -> Graph:
    """Terms lie by documents; only ids that several rows have bring them to be counted together."""
    if docs.groupBy("doc_idx").count().where("count > 1").isEmpty():
        chunks = stored(counted_terms(docs), "chunks")
        of_chunks = stored(walk.chunk_entities(chunks), "chunk-entities")
        table = of_chunks.groupBy("entity").agg(F.sum("df").alias("df"), F.min(F.struct("first_doc", "first_pos")).alias("first"))
        entities = stored(_within(table.withColumn("first", F.struct(F.col("first.first_doc").alias("doc_idx"), F.col("first.first_pos").alias("pos"))), docs, min_df, max_df_ratio), "entities")
        # the chunks go when blocks are made of them; edges, if asked for, are counted from the texts
        pairs = weighted_pairs(walk.chunk_pairs(counted_terms(docs)), entities, docs)
        return Graph(entities, docs.select("doc_idx"), pairs, None, normalization, chunks=chunks, found=of_chunks)
    found = stored(term_mentions(docs), "mentions")
    items = found.groupBy("doc_idx").agg(F.collect_list(F.struct("entity", "tf")).alias("items"))
    entities = stored(entity_table(found, docs, min_df, max_df_ratio), "entities")
    pairs = weighted_pairs(found, entities, docs)
    return Graph(entities, docs.select("doc_idx"), pairs, items, normalization)


def graph_stats(graph: Graph) -> DataFrame:
    """One row: nodes, entities, docs, edges, and avg, p95 and max degree of both kinds, isolated nodes included."""

    def degrees(nodes: DataFrame, key: str, name: str) -> DataFrame:
        own = graph.pairs.groupBy(key).agg(F.count("*").alias("deg"))
        all_ = nodes.join(own, key, "left").select(F.coalesce("deg", F.lit(0)).alias("deg"))
        return all_.agg(F.count("*").alias(f"{name}s"), F.avg("deg").alias(f"{name}_avg"), F.percentile("deg", F.lit(0.95)).alias(f"{name}_p95"), F.max("deg").alias(f"{name}_max"))

    both = degrees(graph.entities, "ent_idx", "entity").crossJoin(degrees(graph.docs, "doc_idx", "doc"))
    return both.crossJoin(graph.pairs.agg(F.count("*").alias("edges"))).withColumn("nodes", F.col("entitys") + F.col("docs")).withColumnRenamed("entitys", "entities")

"""Entity resolution (E01-E23): exact labels, fuzzy labels behind blocking and guards, a judge, and rewriting.

Labels are compared only if they name the same numbers, all with all where few do, else if they
share a MinHash band; a pair counts once, scores are taken in Arrow batches, and the merges'
components by label propagation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as S
from ..schema import Graph
from .build import apply_remap
from .communities import components
from .joins import remap
from .scratch import written

ENTROPY_FLOOR, JACCARD_FLOOR, MERGE_SCORE, COMMUNITY_BOOST = 2.5, 0.7, 92.0, 5.0
JUDGE_BAND = (75.0, 92.0)
PERMUTATIONS, BANDS = 128, 32
PRIME = (1 << 31) - 1
FEW = 32  # labels that name the same numbers: so many are compared all with all, more by their bands


def id_prefixes(path: Column) -> Column:
    """The identifiers under which a file may have defined a node, from its last path parts."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\.[^./]+$", "")), r"[^a-z0-9]+")
    parts = F.filter(parts, lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, -i, i), "_"))


def defines_id(id_: Column, path: Column) -> Column:
    """Whether the id starts with its own file's identifier."""
    return F.exists(id_prefixes(F.coalesce(path, F.lit(""))), lambda p: (p != "") & ((id_ == p) | F.startswith(id_, F.concat(p, F.lit("_")))))


def resolve_id_collisions(nodes: DataFrame) -> DataFrame:
    """One node per id: a definer, then the shorter label, then label and file in order. Only ids that occur again are ranked."""
    again = written(nodes.groupBy("id").count().where("count > 1").select("id"), "again")
    rank = [(~defines_id(F.col("id"), F.col("source_file"))).asc(), F.char_length("label").asc(), F.col("label").asc(), F.col("source_file").asc()]
    best = nodes.join(again, nodes["id"].eqNullSafe(again["id"]), "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(*rank))).where("_rn = 1").drop("_rn")
    return nodes.join(again, nodes["id"].eqNullSafe(again["id"]), "left_anti").unionByName(best)


def winner_rank(id_: Column) -> Column:
    """The order in which ids win: no chunk suffix, then short, then by name."""
    return F.struct(id_.rlike(r"_c\d+$"), F.char_length(id_), id_)


def exact_pairs(nodes: DataFrame, norm: Column) -> DataFrame:
    """(old, new) among nodes of one normalised label and one file that are not code."""
    keyed = nodes.withColumn("_norm", norm).where("_norm <> '' and coalesce(source_file, '') <> '' and file_type <> 'code'")
    best = keyed.groupBy("_norm", "source_file").agg(F.min_by("id", winner_rank(F.col("id"))).alias("new"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(best, ["_norm", "source_file"]).where("id <> new").select(F.col("id").alias("old"), "new")


def minhash(shingles: Column, n: int = PERMUTATIONS) -> Column:
    """A MinHash signature. Shingles are hashed once; permutation k is (a_k * h + b_k) mod p."""
    hashes = F.transform(shingles, lambda s: F.pmod(F.xxhash64(s), F.lit(PRIME)))
    coefficients = F.array(*[F.struct(F.lit(1 + (k * 2654435761 + 12345) % (PRIME - 1)).alias("a"), F.lit((k * 40503 + 977) * 7919 % PRIME).alias("b")) for k in range(n)])
    return F.transform(coefficients, lambda c: F.array_min(F.transform(hashes, lambda h: F.pmod(h * c["a"] + c["b"], F.lit(PRIME)))))


def minhash_jaccard(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def number_key(norm: Column) -> Column:
    """A hash of the numbers that a label names. Labels with different numbers never merge (`numeric_tokens_differ`)."""
    return F.xxhash64(F.array_join(S.numeric_tokens(norm), ","))


def not_alone(labels: DataFrame) -> DataFrame:
    """The labels (norm) that name the same numbers as another one, with the key and size of their group (numbers, crowd); the others have no partner."""
    keyed = labels.withColumn("numbers", number_key(F.col("norm")))
    crowds = keyed.groupBy("numbers").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    return keyed.join(crowds, "numbers")


def candidate_pairs(labels: DataFrame, floor: float = JACCARD_FLOOR) -> DataFrame:
    """(a, b) of labels (key, norm) whose shingles are at least floor alike, by exact Jaccard.

    Where at most FEW labels name the same numbers they are compared all with all; of larger groups
    (such as labels without numbers) only labels that share a band are. The join is between written
    tables, so that adaptive execution can split a band that is hot all the same.
    """
    prepared = written(not_alone(labels.select("key", "norm")), "labels")
    few = prepared.where(F.col("crowd") <= FEW).select("key", "norm", "numbers")
    near = few.toDF("a", "a_norm", "numbers").join(few.toDF("b", "b_norm", "numbers"), "numbers").where("a < b")
    near = near.where(jaccard(S.shingles(F.col("a_norm")), S.shingles(F.col("b_norm"))) >= floor).select("a", "b")
    many = written(prepared.where(F.col("crowd") > FEW).withColumn("_sh", S.shingles(F.col("norm"))), "crowded")
    rows = PERMUTATIONS // BANDS
    signed = many.withColumn("_sig", minhash(F.col("_sh")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("no"), F.xxhash64(F.slice(F.col("_sig"), i * rows + 1, rows)).alias("h")))
    banded = written(signed.select("key", F.explode(bands).alias("band"), "numbers").select("key", "band.no", F.xxhash64("band.h", "numbers").alias("h")), "bands")
    pairs = banded.withColumnRenamed("key", "a").join(banded.withColumnRenamed("key", "b"), ["no", "h"]).where("a < b").select("a", "b").distinct()
    side = lambda p: many.select(F.col("key").alias(p), F.col("_sh").alias(f"_{p}_sh"))
    return near.unionByName(pairs.join(side("a"), "a").join(side("b"), "b").where(jaccard(F.col("_a_sh"), F.col("_b_sh")) >= floor).select("a", "b"))


def crossfile_anchored(prefix: str = "") -> Column:
    """Rationale and document nodes of different files do not merge."""
    anchored = lambda c: F.col(c).isin("rationale", "document")
    return (anchored("a_type") | anchored("b_type")) & (F.coalesce("a_file", F.lit("")) != F.coalesce("b_file", F.lit("")))


def fuzzy_scores(nodes: DataFrame, norm: Column, communities: DataFrame | None = None) -> DataFrame:
    """Scored pairs of nodes that are not code, with distinct labels of enough entropy, and whether a guard blocks them."""
    keyed = nodes.where("file_type <> 'code'").withColumn("norm", norm).where("norm <> ''")
    one = keyed.groupBy("norm").agg(F.min_by(F.struct("id", "file_type", "source_file"), winner_rank(F.col("id"))).alias("n")).select(F.col("n.id").alias("key"), "norm", F.col("n.file_type").alias("type"), F.col("n.source_file").alias("file"))
    # Written first, else the dear entropy is pushed down to labels that have no partner; what follows reads them several times.
    one = written(written(not_alone(one).drop("numbers", "crowd"), "partnered").where(S.entropy(F.col("norm")) >= ENTROPY_FLOOR), "labels")
    side = lambda p: one.select(F.col("key").alias(p), F.col("norm").alias(f"{p}_norm"), F.col("type").alias(f"{p}_type"), F.col("file").alias(f"{p}_file"))
    pairs = candidate_pairs(one.select("key", "norm")).join(side("a"), "a").join(side("b"), "b")
    a, b = F.col("a_norm"), F.col("b_norm")
    long_across = (F.coalesce("a_file", F.lit("")) != F.coalesce("b_file", F.lit(""))) & (F.greatest(F.char_length(a), F.char_length(b)) >= 12)
    scored = pairs.withColumn("jw", S.jaro_winkler_score(a, b)).withColumn("score", F.when(long_across, S.jaro_score(a, b)).otherwise(F.col("jw")))
    if communities is not None:
        c = lambda p: communities.select(F.col("node_id").alias(p), F.col("cid").alias(f"{p}_cid"))
        scored = scored.join(c("a"), "a", "left").join(c("b"), "b", "left").withColumn("score", F.col("score") + F.when(F.col("a_cid") == F.col("b_cid"), COMMUNITY_BOOST).otherwise(0.0))
    blocked = S.is_variant_pair(a, b) | S.short_label_blocked(a, b, F.col("jw")) | S.numeric_tokens_differ(a, b) | S.is_prefix_extension(a, b) | crossfile_anchored()
    return scored.withColumn("blocked", blocked).select("a", "b", "a_norm", "b_norm", "score", "blocked")


def fuzzy_pairs(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("score") >= MERGE_SCORE) & ~F.col("blocked")).select("a", "b")


def judged_pairs(scored: DataFrame, judge: Callable[[str, str], str]) -> DataFrame:
    """Pairs in the doubtful band that a judge calls Merge."""
    band = scored.where((F.col("score") >= JUDGE_BAND[0]) & (F.col("score") < JUDGE_BAND[1]) & ~F.col("blocked"))
    return band.where(S.pair_scores(judge, "string")(F.col("a_norm"), F.col("b_norm")) == "Merge").select("a", "b")


def merge_map(pairs: DataFrame) -> DataFrame:
    """(old, new) from merge pairs, over components."""
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("old"), F.col("b").alias("new"))
    found = components(pairs)
    best = found.groupBy("component").agg(F.min_by("id", winner_rank(F.col("id"))).alias("new"))
    return found.join(best, "component").where("id <> new").select(F.col("id").alias("old"), "new")


def rewrite_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Endpoints through the mapping; self-loops go."""
    return remap(remap(edges, "source", mapping), "target", mapping).where("source <> target").select(edges.columns)


def deduplicate_entities(graph: Graph, communities: DataFrame | None = None, judge: Callable[[str, str], str] | None = None, norm: Column | None = None) -> Graph:
    """Exact pass, fuzzy pass, judge, one mapping, rewriting. Refuses nodes of several repositories."""
    if "repo" in graph.nodes.columns and graph.nodes.where("repo is not null").select("repo").distinct().limit(2).count() > 1:
        raise ValueError("entities of several repositories are not merged")
    norm = S.entity_norm(F.col("label")) if norm is None else norm
    nodes = written(resolve_id_collisions(graph.nodes), "nodes")
    pairs = exact_pairs(nodes, norm).toDF("a", "b")
    scored = written(fuzzy_scores(nodes, norm, communities))
    pairs = pairs.unionByName(fuzzy_pairs(scored))
    if judge is not None:
        pairs = pairs.unionByName(judged_pairs(scored, judge))
    mapping = written(merge_map(pairs))
    return apply_remap(graph.with_(nodes=nodes), mapping).with_(edges=rewrite_edges(graph.edges, mapping))

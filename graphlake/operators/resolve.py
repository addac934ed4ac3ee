"""Resolution of names and imports across files, as prioritised joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.schema import make_edges


def longest_prefix(candidates: DataFrame, modules: DataFrame, key: str = "candidate") -> DataFrame:
    """candidates with ``module_file``: the file whose module path is the longest dotted prefix of the candidate, '' included; of files with the same path the last."""
    last = modules.groupBy("module_path").agg(F.max_by("file_id", F.struct("path", "file_id")).alias("module_file"))
    parts = F.split(key, r"\.")
    prefixes = candidates.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.size(parts))).alias("n")).select(key, "n", F.array_join(F.slice(F.split(key, r"\."), 1, F.col("n")), ".").alias("module_path"))
    best = prefixes.join(last, "module_path").groupBy(key).agg(F.max_by("module_file", "n").alias("module_file"))
    return candidates.join(best, key, "left")


def resolve_names(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """uses (src, file_id, parent_symbol_id, raw, ordinal, kind_filter) with ``target`` and ``weight`` of the first rule that hits.

    1 own class: self.x or cls.x where the parent symbol is a class; 2 the import table's candidate with the rest, 3 without it;
    4 the one symbol of that name in the file (0.9); 5 the one in all files (0.4). Rules 4 and 5 take names without dots
    only. kind_filter, if not null, is the kind a target must have; symbols of other kinds do not count for any rule. Module
    symbols are never targets.
    """
    named = symbols.where("kind <> 'module'")
    qualified = named.groupBy("qualified_name").agg(F.max_by(F.struct("id", "kind"), F.struct("file_id", "order_index")).alias("q"))
    qualified = qualified.select("qualified_name", F.col("q.id").alias("target"), F.col("q.kind").alias("target_kind"))
    u = uses.withColumn("name", F.trim("raw")).where("name <> ''").withColumn("root", F.substring_index("name", ".", 1)).withColumn("rest", F.when(F.contains("name", F.lit(".")), F.expr("substring(name, length(root) + 2)")))
    parents = symbols.where("kind = 'class'").select(F.col("id").alias("parent_symbol_id"), F.col("qualified_name").alias("parent_name"))
    table = imports.select("file_id", F.col("local").alias("root"), "candidate")
    keys = ["src", "ordinal", "raw", "kind_filter"]

    def by_name(of: DataFrame, name: Column, rule: int, weight: float) -> DataFrame:
        wanted = of.select(*keys, name.alias("qualified_name"))
        return wanted.join(qualified, "qualified_name").select(*keys, F.lit(rule).alias("rule"), "target", "target_kind", F.lit(weight).alias("weight"))

    own = u.where(F.col("root").isin("self", "cls") & F.col("rest").isNotNull() & ~F.contains("rest", F.lit("."))).join(parents, "parent_symbol_id")
    imported = u.join(table, ["file_id", "root"])
    plain = u.where("rest is null")
    found = by_name(own, F.concat("parent_name", F.lit("."), "rest"), 1, 1.0)
    found = found.unionByName(by_name(imported.where("rest is not null"), F.concat("candidate", F.lit("."), "rest"), 2, 1.0))
    found = found.unionByName(by_name(imported, F.col("candidate"), 3, 1.0))
    # a name counts among the symbols of the wanted kind only; without one, among all
    kinds = named.select("id", "file_id", "name", "kind", F.explode(F.array(F.col("kind"), F.lit("*"))).alias("wanted"))
    one = [F.count("*").alias("n"), F.first(F.struct("id", "kind")).alias("s")]
    in_file = kinds.groupBy("file_id", "name", "wanted").agg(*one).where("n = 1")
    anywhere = kinds.groupBy("name", "wanted").agg(*one).where("n = 1")
    plain = plain.withColumn("wanted", F.coalesce("kind_filter", F.lit("*")))
    pick = lambda d, rule, weight: d.select(*keys, F.lit(rule).alias("rule"), F.col("s.id").alias("target"), F.col("s.kind").alias("target_kind"), F.lit(weight).alias("weight"))
    found = found.unionByName(pick(plain.join(in_file, ["file_id", "name", "wanted"]), 4, 0.9)).unionByName(pick(plain.join(anywhere, ["name", "wanted"]), 5, 0.4))
    found = found.where(F.col("kind_filter").isNull() | (F.col("kind_filter") == F.col("target_kind")))
    first = Window.partitionBy("src", "ordinal", "raw").orderBy("rule")
    return found.withColumn("__r", F.row_number().over(first)).where("__r = 1").select("src", "ordinal", "raw", "rule", "target", "weight")


def static_edges(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """IMPORTS, INHERITS_FROM and CALLS edges: one per (source, target, type), first weight kept; loops only for CALLS."""
    linked = longest_prefix(imports, files.select("file_id", "path", "module_path"))
    imported = linked.where("module_file is not null and module_file <> file_id").select(F.col("file_id").alias("src"), F.col("module_file").alias("target"), F.lit(1.0).alias("weight"), F.lit("IMPORTS").alias("rel"), F.lit(0).alias("at"))
    base = symbols.select(F.col("id").alias("src"), "file_id", "parent_symbol_id", F.posexplode("base_classes").alias("ordinal", "raw"), F.lit("class").alias("kind_filter"))
    call = symbols.select(F.col("id").alias("src"), "file_id", "parent_symbol_id", F.posexplode("calls_raw").alias("ordinal", "raw"), F.lit(None).cast("string").alias("kind_filter"))
    inherits = resolve_names(base, symbols, imports).select("src", "target", "weight", F.lit("INHERITS_FROM").alias("rel"), F.col("ordinal").alias("at")).where("src <> target")
    calls = resolve_names(call, symbols, imports).select("src", "target", "weight", F.lit("CALLS").alias("rel"), F.col("ordinal").alias("at"))
    once = imported.unionByName(inherits).unionByName(calls).groupBy("src", "target", "rel").agg(F.min_by("weight", "at").alias("weight"))
    c = F.col
    return make_edges(once, c("src"), c("target"), c("rel"), "static_analysis", c("weight"))

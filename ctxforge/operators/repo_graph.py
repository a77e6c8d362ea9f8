"""Directory digests over parsed files: (ord, path, language, imports, exports), ord the listing's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxforge.functions.tokens import savings
from ctxforge.sources.scratch import written

# Import prefixes that name a technology, first match wins.
STACK = (
    ("react", "React"), ("next", "Next.js"), ("vue", "Vue"), ("express", "Express"), ("fastify", "Fastify"), ("@nestjs", "NestJS"), ("prisma", "Prisma"), ("@prisma", "Prisma"),
    ("typeorm", "TypeORM"), ("mongoose", "Mongoose"), ("zod", "Zod"), ("@modelcontextprotocol", "MCP"), ("vitest", "Testing"), ("jest", "Testing"),
)
# Lower-cased relative paths that matter, first match wins.
IMPORTANT = (
    (r"^(src/)?index\.(ts|js)$", "Entry point"), (r"^(src/)?main\.(ts|js)$", "Main entry"), (r"^(src/)?app\.(ts|js|tsx)$", "App root"),
    (r"server/index\.(ts|js)$", "Server entry"), (r"config\.(ts|js)$", "Configuration"), (r"types/index\.(ts|js)$", "Type definitions"),
)
MOST_IMPORTANT, MOST_EDGES, MOST_DIRS, MOST_LANGUAGES = 15, 50, 8, 3


def resolve(path: Column, target: Column) -> Column:
    """A relative import seen from a file: the joined path with . and .. taken out."""
    parts = F.concat(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), F.split(target, "/"))

    def step(kept: Column, part: Column) -> Column:
        up = F.when((F.size(kept) > 0) & (F.element_at(F.concat(F.array(F.lit("")), kept), -1) != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))
        return F.when((part == "") | (part == "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def dependency_edges(files: DataFrame) -> DataFrame:
    """(ord, src, place, dst): relative imports that name a listed file as it is, with .ts, .js or /index.ts;
    the first such file of the listing."""
    imports = files.select("ord", F.col("path").alias("src"), F.posexplode(F.transform("imports", lambda i: i["source"])).alias("place", "source")).where(F.col("source").startswith("."))
    target = resolve(F.col("src"), F.col("source"))
    wanted = imports.withColumn("t", target).withColumn("candidate", F.explode(F.array("t", *(F.concat("t", F.lit(x)) for x in (".ts", ".js", "/index.ts")))))
    listed = files.groupBy(F.col("path").alias("candidate")).agg(F.min("ord").alias("dst_ord"))
    found = wanted.join(listed, "candidate").groupBy("ord", "src", "place").agg(F.min_by("candidate", "dst_ord").alias("dst"))
    return found


def dependency_graph(files: DataFrame) -> DataFrame:
    """(src, deps): deps in import order, repeats kept."""
    return dependency_edges(files).groupBy("ord", "src").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "dst"))), lambda x: x["dst"]).alias("deps"))


def relationships(files: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    return dependency_edges(files).orderBy("ord", "place").limit(most).select("ord", "place", F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("imports").alias("relationship"))


def import_popularity(files: DataFrame) -> DataFrame:
    one = files.select(F.explode(F.transform("imports", lambda i: i["source"])).alias("source")).where(F.col("source").startswith("."))
    return one.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def language_mix(files: DataFrame, most: int = MOST_LANGUAGES) -> DataFrame:
    counted = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(most).select("language", "n")


def technology(source: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in reversed(STACK):
        out = F.when(source.startswith(prefix), name).otherwise(out)
    return out


def tech_stack(files: DataFrame) -> DataFrame:
    """(place, name): technologies in order of first import, then the leading languages."""
    imports = files.select("ord", F.posexplode(F.transform("imports", lambda i: i["source"])).alias("k", "source")).withColumn("name", technology(F.col("source")))
    first = imports.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct(F.lit(0).alias("tier"), F.col("ord").cast("long").alias("ord"), "k")).alias("at"))
    counted = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(MOST_LANGUAGES)
    order = Window.orderBy(F.desc("n"), "first")  # three rows
    languages = counted.withColumn("k", F.row_number().over(order)).where("language <> 'unknown'")
    title = F.concat(F.upper(F.substring("language", 1, 1)), F.expr("substring(language, 2)"))
    second = languages.select(title.alias("name"), F.struct(F.lit(1).alias("tier"), F.lit(0).cast("long").alias("ord"), "k").alias("at"))
    both = first.unionByName(second).groupBy("name").agg(F.min("at").alias("at"))  # as many rows as names
    return both.select(F.row_number().over(Window.orderBy("at")).alias("place"), "name")


def directory_structure(files: DataFrame, most: int = MOST_DIRS) -> DataFrame:
    counted = files.groupBy(F.element_at(F.split("path", "/"), 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(most).select("dir", "n", "first")


def important_reason(path: Column, n_exports: Column) -> Column:
    out = F.when(n_exports > 5, F.concat(F.lit("High export count ("), n_exports.cast("string"), F.lit(" exports)")))
    for pattern, reason in reversed(IMPORTANT):
        out = F.when(F.lower(path).rlike(pattern), reason).otherwise(out)
    return out


def important_files(files: DataFrame, most: int = MOST_IMPORTANT) -> DataFrame:
    """(ord, path, reason): the first of the listing, each path once."""
    named = files.select("ord", "path", important_reason(F.col("path"), F.size("exports")).alias("reason")).where(F.col("reason").isNotNull())
    once = named.groupBy("path").agg(F.min("ord").alias("ord"), F.min_by("reason", "ord").alias("reason"))
    return once.orderBy("ord").limit(most).select("ord", "path", "reason")


def entry_points(files: DataFrame) -> DataFrame:
    return important_files(files).where("reason LIKE '%entry%' OR reason LIKE '%Entry%'")


def compress_directory(files: DataFrame, base: str) -> DataFrame:
    """One row: architecture, entry points, technologies, and savings over the listing of imports and exports."""
    files = written(files, "parsed-files")  # parsed once for the seven digests below
    joined = lambda df, value, order: df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.expr(value).alias("v")))), lambda x: x["v"]), ", "))
    names = lambda df, value, order, label: joined(df, value, order).toDF(label)
    ranked = directory_structure(files).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first")))  # eight rows
    important = important_files(files)
    listing = F.concat(F.lit("// "), F.col("path"), F.lit("\n"), F.array_join(F.transform("imports", lambda i: i["source"]), "\n"), F.lit("\n"), F.array_join("exports", "\n"))
    one = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(listing)).alias("chars"))
    one = one.crossJoin(names(tech_stack(files), "name", "place", "tech")).crossJoin(names(ranked, "concat(dir, '/ (', n, ' files)')", "place", "dirs"))  # single rows
    one = one.crossJoin(names(entry_points(files), "path", "ord", "entries"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("ord", "path", "reason"))), lambda x: F.struct(x["path"].alias("path"), x["reason"].alias("reason")))
    one = one.crossJoin(important.agg(F.to_json(pairs).alias("important"))).crossJoin(tech_stack(files).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])).alias("tech_json")))
    architecture = F.concat_ws(
        ". ", F.lit(f"Directory: {base}"), F.concat(F.lit("Files analyzed: "), F.col("n").cast("string")),
        F.concat(F.lit("Tech stack: "), F.when(F.col("tech") == "", "Unknown").otherwise(F.col("tech"))), F.concat(F.lit("Structure: "), F.col("dirs")),
        F.when(F.col("entries") != "", F.concat(F.lit("Entry points: "), F.col("entries"))),
    )
    one = one.withColumn("architecture", architecture)
    shown = F.concat("architecture", F.lit('\n{"importantFiles":'), F.col("important"), F.lit(',"techStack":'), F.col("tech_json"), F.lit("}"))
    original = F.ceil((F.coalesce("chars", F.lit(0)) + 2 * F.greatest(F.col("n") - 1, F.lit(0))) / 4).cast("long")
    return one.select("architecture", F.col("entries").alias("entry_points"), "tech", savings(original, F.ceil(F.length(shown) / 4).cast("long")).alias("tokens"))

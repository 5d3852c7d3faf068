"""API inventory, progress report, class hierarchy, initializers, move plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import texts as T
from . import ordered
from .quality import checked
from .sizing import checkpointed, lookup_join


def declarations(df: DataFrame, line: str, prefix: str) -> DataFrame:
    """Lines ``ret name (params`` or ``name (params`` where the name starts
    with ``prefix``: adds ``returntype`` (null without one), ``symbol`` and
    ``paramtypes``; other lines are dropped."""
    pattern = rf"^(?:([{S.IDENTIFIER_CHARS}]+) )?({prefix}[{S.IDENTIFIER_CHARS}]+) \((.*)$"
    part = lambda i: F.regexp_extract(F.col(line), pattern, i)
    params = F.regexp_replace(F.regexp_replace(part(3), r"\);$", ""), r",$", "")
    return (df.where(F.col(line).rlike(pattern))
            .withColumn("returntype", F.nullif(part(1), F.lit("")))
            .withColumn("symbol", part(2))
            .withColumn("paramtypes", F.transform(F.split(T.stripped(params), ",", -1), parameter_type)))


def parameter_type(declared: Column) -> Column:
    """Type of a parameter: up to the last ``*`` before its name, else all but
    the last word; ``const char *`` without a name stays."""
    pointer = r"^(.+\*)(\S+)"
    all_but_last = S.let(T.words(declared), lambda w: F.array_join(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), " "))
    return (F.when(declared == "const char *", declared)
            .when(declared.rlike(pointer), T.stripped(F.regexp_extract(declared, pointer, 1)))
            .otherwise(all_but_last))


def has_prefix(name: Column, prefix: str, *but: str) -> Column:
    """Name starts with ``prefix`` and with none of the prefixes ``but``."""
    wanted = name.startswith(prefix)
    for other in but:
        wanted = wanted & ~name.startswith(other)
    return wanted


def distinct_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key, sorted by key."""
    return ordered.first_in_key(df, [key], order).orderBy(key)


def without_listed(df: DataFrame, listed: DataFrame, on: list[str],
                   spread_by: list[str] | None = None) -> DataFrame:
    return lookup_join(df, listed.select(*on).distinct(), on, "left_anti", spread_by)


def only_listed(df: DataFrame, listed: DataFrame, on: list[str],
                spread_by: list[str] | None = None) -> DataFrame:
    return lookup_join(df, listed.select(*on).distinct(), on, "left_semi", spread_by)


def report(df: DataFrame, **predicates: Column) -> DataFrame:
    """How many rows meet each predicate: ``title, n``, from one pass."""
    counts = df.agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("title"), F.col(n).alias("n")) for n in predicates])
    return counts.select(F.inline(pairs))


def classify(df: DataFrame, name: str, prefixes: DataFrame, prefix: str,
             fallbacks: list[str] = ()) -> DataFrame:
    """Longest prefix of each name: adds ``prefix``; a name without one takes
    the first fallback it starts with, or has a ``problem``.

    Names are cut to the lengths that occur among the prefixes, and the heads
    are joined by equality; distinct names are looked up, not rows.
    """
    lengths = (prefixes.select(F.length(prefix).alias("__len")).distinct()
               .agg(F.sort_array(F.collect_list("__len")).alias("__lens")))
    # One row; the array is bounded by the length of the longest prefix.
    cut = F.transform(F.filter("__lens", lambda n: n <= F.length(name)),
                      lambda n: F.substring(F.col(name), F.lit(1), n))
    heads = S.unnest(df.select(name).distinct().withColumn("__lens", lengths.scalar()),
                     [name], cut, prefix).drop("nth")
    best = (lookup_join(heads, prefixes.select(prefix).distinct(), [prefix], "inner", [name])
            .groupBy(name).agg(F.max_by(prefix, F.length(prefix)).alias(prefix)))
    backup = F.lit(None).cast("string")
    for f in reversed(fallbacks):
        backup = F.when(F.col(name).startswith(f), F.lit(f)).otherwise(backup)
    placed = (lookup_join(df, best, [name], "left", [c for c in df.columns])
              .withColumn(prefix, F.coalesce(F.col(prefix), backup)))
    return checked(placed, (F.col(prefix).isNull(), "no prefix"))


def without_const(kind: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(kind, "^const_", ""), "^const ", "")


def progress(df: DataFrame, group: list[str], done: Column) -> DataFrame:
    """Per group ``done``, ``todo`` and the percentage, rounded down."""
    return (df.groupBy(*group).agg(F.count_if(done).alias("done"), F.count_if(~done).alias("todo"))
            .withColumn("percentage", F.expr("done * 100 div (done + todo)")))


def complete_groups(stats: DataFrame, group: list[str]) -> DataFrame:
    return stats.where("todo = 0").orderBy(*group)


def ranked(stats: DataFrame, group: list[str], limit: int | None = None) -> DataFrame:
    """Groups by percentage, name, done and todo, greatest first."""
    table = stats.orderBy(*[F.col(c).desc() for c in ["percentage", *group, "done", "todo"]])
    return table if limit is None else table.limit(limit)


def catalogue(df: DataFrame, keep: list[str], text: str, pattern: str, fields: list[str]) -> DataFrame:
    """One row per entry of a definition file, its groups as columns, with
    ``ord``, the place in the file."""
    segs = S.segments(F.col(text), pattern, len(fields))
    return (S.unnest(df, keep, segs, "e", "ord")
            .select(*keep, "ord", *[F.col(f"e.g{i + 1}").alias(f) for i, f in enumerate(fields)]))


# The forms of the definition files and of a subclass.
STRUCT_ENTRY = r"(?dm)^DEFGSSTRUCT\((.+?), (.+?), (.+?)\)$"
CODE_ENTRY = r'(?dms)^DEFGSCODE\((.+?),\s+"(.+?)",\s+(.+?)\)$'
SUBCLASS = (r"(?dms)struct\s+GTY\(\((.*?)\)\)\s+([_a-zA-Z][_a-zA-Z0-9]*?)\s+:\s+public\s+"
            r"([_a-zA-Z][_a-zA-Z0-9]*?)\s")


def class_edges(df: DataFrame, text: str, seeds: DataFrame) -> DataFrame:
    """Edges ``child, parent`` of subclass declarations, with the roots of
    ``seeds(child, parent)``, whose parents are null."""
    found = catalogue(df, [], text, SUBCLASS, ["options", "child", "parent"]).select("child", "parent")
    return found.union(seeds.select("child", "parent")).distinct()


def chained_lookup(df: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Lookup after lookup: each step is (table, key here, key there)."""
    for table, here, there in steps:
        df = lookup_join(df, table.withColumnRenamed(there, here), [here], "inner")
    return df


def closure(edges: DataFrame) -> DataFrame:
    """All ``(node, ancestor, depth)`` of ``child, parent`` edges, with the
    node itself at depth 0; ``depth`` is that of the shortest way.  A null
    parent marks a root.

    Most nodes are leaves, so pairs are made for inner nodes only (nodes that
    are a parent); the leaves are joined once at the end.  Each round joins the
    pairs with themselves, which doubles the depth they reach, and the rounds
    end when nothing new appears: a hierarchy of any depth, or a cycle, ends.
    Each round is checkpointed, which cuts the lineage and survives lost
    executors.
    """
    known = edges.where("parent is not null").select("child", "parent").distinct()
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).where(
        "node is not null").distinct()
    parents = known.select("parent").distinct()
    inner = known.join(parents.select(F.col("parent").alias("child")), "child", "left_semi").where("child <> parent")

    def size(pairs: DataFrame):
        return pairs.agg(F.count("*").alias("n"), F.sum("depth").alias("depths")).first()

    pairs = checkpointed(inner.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"),
                                      F.lit(1).cast("bigint").alias("depth")))
    seen = size(pairs)
    while seen["n"]:
        above = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__next"),
                             F.col("depth").alias("__more"))
        longer = pairs.join(above, "ancestor").select(
            "node", F.col("__next").alias("ancestor"), (F.col("depth") + F.col("__more")).alias("depth"))
        pairs = checkpointed(pairs.union(longer).where("node <> ancestor").groupBy("node", "ancestor").agg(
            F.min("depth").alias("depth")))
        before, seen = seen, size(pairs)
        if seen == before:
            break
    inner_closed = pairs.union(parents.select("parent", "parent", F.lit(0).cast("bigint")))
    higher = (known.where("child <> parent").join(inner_closed.select(
        F.col("node").alias("parent"), "ancestor", F.col("depth").alias("__d")), "parent")
        .where(F.col("child") != F.col("ancestor")).groupBy(F.col("child").alias("node"), "ancestor")
        .agg((F.min("__d") + 1).cast("int").alias("depth")))
    return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).union(higher)


def ancestors(closed: DataFrame) -> DataFrame:
    """``node, path``: ancestors from the root down to the node itself.  The
    array is as long as the hierarchy is deep."""
    return (closed.groupBy("node").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("depth")).alias("d"), F.col("ancestor").alias("a")))).alias("__p"))
        .select("node", F.transform("__p", lambda x: x["a"]).alias("path")))


def descendants(closed: DataFrame) -> DataFrame:
    """``node, descendant, depth``, with the node itself."""
    return closed.select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def castable(codes: DataFrame, closed: DataFrame, struct: str, order: str) -> DataFrame:
    """Codes whose struct is the given ancestor or below it: adds ``ancestor``,
    sorted in catalogue order."""
    up = closed.select(F.col("node").alias(struct), "ancestor")
    return lookup_join(codes, up, [struct], "inner").orderBy("ancestor", order)


# Structs whose union field does not follow the rule.
UNION_FIELDS = {
    "gimple_statement_base": "gsbase",
    "gimple_statement_with_ops": "gsops",
    "gimple_statement_with_memory_ops_base": "gsmembase",
    "gimple_statement_with_memory_ops": "gsmem",
    "gimple_statement_omp": "omp",
}
STRUCT_PREFIX = "gimple_statement_"
# Fixed value: the one type whose accessors use another prefix.
ACCESSOR_NAMES = {"gimple_with_cleanup_expr": "gimple_wce"}


def special_or(name: Column, special: dict[str, str], rule: Column) -> Column:
    """The listed value of a name, else the rule."""
    table = F.create_map(*[F.lit(x) for pair in special.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), rule)


def after_prefix(name: Column, prefix: str) -> Column:
    """Rest of a name after a prefix it must have, else null."""
    return F.when(name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name)))


def union_field(struct: Column) -> Column:
    return special_or(struct, UNION_FIELDS, F.concat(F.lit("gimple_"), after_prefix(struct, STRUCT_PREFIX)))


def instance_name(struct: Column) -> Column:
    return F.concat(after_prefix(struct, STRUCT_PREFIX), F.lit("_stmt"))


def accessor_prefix(kind: Column) -> Column:
    return F.concat(special_or(kind, ACCESSOR_NAMES, kind), F.lit("_"))


def clean_field(field: Column) -> Column:
    """A field without comments, newlines and outer blanks; flags evenly spaced."""
    flat = F.regexp_replace(T.stripped(F.regexp_replace(field, r"/\*.*\*/", "")), "\n", " ")
    return F.when(flat.contains("|"), F.array_join(flags(flat), " | ")).otherwise(flat)


def flags(field: Column) -> Column:
    return F.transform(F.split(field, r"\|", -1), T.stripped)


def initializer_fields(text: Column, names: list[str], drop_empty: bool = False) -> Column:
    """``struct`` of the comma-separated fields, null unless there are exactly
    as many as names.  A trailing comma is allowed; extra fields of a pass are
    read with ``drop_empty``, which leaves out all empty ones."""
    def shape(fields: Column) -> Column:
        tail = (F.size(fields) == len(names) + 1) & (F.element_at(fields, -1) == "")
        return S.let(F.when(tail, F.slice(fields, F.lit(1), F.lit(len(names)))).otherwise(fields),
                     lambda kept: F.when(F.size(kept) == len(names), F.struct(
                         *[F.get(kept, F.lit(i)).alias(n) for i, n in enumerate(names)])))
    fields = F.transform(F.split(text, ",", -1), clean_field)
    return S.let(F.filter(fields, lambda f: f != "") if drop_empty else fields, shape)


def constructor_fields(text: Column, names: list[str]) -> Column:
    """``struct`` of the arguments of a pass constructor: the lines from the
    third on, without line ends; an empty body in the last place is ``NULL``."""
    arguments = F.array_join(S.let(F.split(text, "\n", -1), lambda l: F.slice(
        l, F.lit(3), F.size(l))), "")
    def shape(fields: Column) -> Column:
        return F.when(F.size(fields) == len(names), F.struct(
            *[(F.when(F.get(fields, F.lit(i)) == "{}", "NULL").otherwise(F.get(fields, F.lit(i)))
               if i == len(names) - 1 else F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(names)]))
    return S.let(F.transform(F.split(arguments, ",", -1), clean_field), shape)


def initializers(df: DataFrame, text: str, names: list[str],
                 fixed: dict[str, str] | None = None, drop_empty: bool = False) -> DataFrame:
    """Fields of initializer texts as columns, and ``problem``: another number
    of fields, or a field of ``fixed`` that does not hold its value."""
    parsed = df.withColumn("__f", initializer_fields(F.col(text), names, drop_empty))
    columns = parsed.select(*df.columns, "__f", *[F.col(f"__f.{n}").alias(n) for n in names])
    rules = [(F.col("__f").isNull(), "wrong number of fields")]
    rules += [(F.col(n) != v, f"{n} is not {v}") for n, v in (fixed or {}).items()]
    return checked(columns, *rules).drop("__f")


def has_value(field: Column) -> Column:
    """False for ``NULL`` and ``0``."""
    return ~field.isin("NULL", "0")


def flag_counts(df: DataFrame, field: str) -> DataFrame:
    return (S.unnest(df, [], flags(F.col(field)), "flag")
            .groupBy("flag").agg(F.count("*").alias("n")))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def with_listed(df: DataFrame, name: str, listed: list[str], out: str = "listed") -> DataFrame:
    """Adds whether a name is in a short fixed list."""
    return df.withColumn(out, F.coalesce(F.col(name).isin(listed), F.lit(False)))


def plan_lines(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """Entries of a move plan: ``keys, order, section, path, remark``.

    A line underlined with ``=`` opens a section; an entry is an indented
    path, with a remark after ``#``.
    """
    before = checkpointed(ordered.lag(lines, keys, order, F.col(line), "__before"))
    title = F.when(F.col(line).rlike(r"^={3,}\s*$"), F.col("__before.v"))
    carried = ordered.carry_forward(before, keys, order, {"section": title})
    entry = r"^\s+(\S+)\s*(?:#\s*(.*))?$"
    return (carried.where(F.col(line).rlike(entry) & F.col("section").isNotNull())
            .select(*keys, order, "section", F.regexp_extract(F.col(line), entry, 1).alias("path"),
                    F.nullif(F.regexp_extract(F.col(line), entry, 2), F.lit("")).alias("remark")))


def new_path(section: Column, path: Column, root: str = "") -> Column:
    """Path in the folder that a section title names in double backquotes,
    else the path as it is."""
    folder = F.regexp_extract(section, r"``([^`]+?)/?``", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(folder == "", path).otherwise(F.concat(F.lit(root), folder, F.lit("/"), name))


def in_several(plan: DataFrame, path: str, section: str) -> DataFrame:
    """Paths that the plan puts into more than one section."""
    return (plan.select(path, section).distinct().groupBy(path)
            .agg(F.count("*").alias("n")).where("n > 1"))

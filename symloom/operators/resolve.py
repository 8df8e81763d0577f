"""Name resolution: import and symbol tables, the resolution cascade, synthetic calls, containment and consolidation.

Raw calls are (call_id, caller, callee_name, crate, module, file, line); ``caller`` is a qualified name. Symbols are functions in the
order (crate, file, line_start, id); where two define one key, the later wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions.text import method_of_pattern
from symloom.sources.tables import release, scratch


def import_table(imports: DataFrame) -> DataFrame:
    """(crate, file, local_name, target, to_crate): one row for each imported item; globs are left out."""
    rows = imports.filter("import_type <> 'Glob'").select("crate", "file", "module_path", F.explode("items").alias("item")).filter("item.name <> '*'")
    target = F.concat_ws("::", F.nullif("module_path", F.lit("")), "item.name")
    named = rows.select("crate", "file", F.coalesce("item.alias", "item.name").alias("local_name"), target.alias("target"))
    return named.withColumn("to_crate", F.split("target", "::")[0])


ORDER = ("crate", "file", "line_start", "id")


def symbol_keys() -> Column:
    """The keys that a definition has: its qualified name, its bare name, and its name below ``crate::``."""
    own = F.when(F.col("qualified_name").startswith(F.concat("crate", F.lit("::"))), F.concat(F.lit("crate"), F.substring("qualified_name", F.length("crate") + 1, F.lit(1 << 20))))
    return F.array_compact(F.array("qualified_name", "name", F.concat_ws("@", own, "crate")))


def winners(keys: DataFrame) -> DataFrame:
    """(key, id, qualified_name, crate) of definitions by key: the last one wins."""
    last = F.max_by(F.struct("id", "qualified_name", "crate"), F.struct(*ORDER))
    return keys.groupBy("key").agg(last.alias("s")).select("key", "s.*")


def grown(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the sources and is not to be broadcast. A table whose names repeat is small in its file and a hundred times as large in memory, and a plan's
    guess counts neither that nor the rows that an ``explode`` makes, so a guess under the threshold would bring millions of rows to the driver."""
    return rows.hint("merge")


def symbol_table(functions: DataFrame) -> DataFrame:
    """(key, id, qualified_name, crate): qualified names, bare names, and names below ``crate::``. The last definition of a key wins."""
    f = functions.select("id", "name", "qualified_name", "crate", "file", "line_start")
    return winners(f.withColumn("key", F.explode(symbol_keys())))


def suffixes(functions: DataFrame, most: int = 3) -> DataFrame:
    """(suffix, id): the last parts of each qualified name, so that a suffix match is an equi-join."""
    parts = F.split("qualified_name", "::")
    cut = lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "::"))
    return functions.select("id", "qualified_name", F.explode(F.array_compact(F.array(*[cut(n) for n in range(1, most + 1)]))).alias("suffix"))


def candidates() -> Column:
    """Keys to try for a call, in order: relative paths and paths as written, through an import, in the module, in the crate, bare."""
    n, path = F.col("callee_name"), F.col("callee_name").contains("::")
    module = F.nullif("module", F.lit(""))
    own = lambda c: F.when(c.startswith("crate::"), F.concat_ws("@", c, "crate"))
    rest = F.regexp_replace(n, "^(self|super)::", "")
    above = F.nullif(F.regexp_replace("module", "(^|::)[^:]*$", ""), F.lit(""))
    relative = F.when(n.startswith("super::"), F.concat_ws("::", "crate", above, rest)).when(n.startswith("self::"), F.concat_ws("::", "crate", module, rest))
    return F.array(own(n), relative, F.when(path, n), own(F.col("target")), F.col("target"), F.concat_ws("::", "crate", module, n), F.concat_ws("::", module, n), F.concat_ws("::", "crate", n), F.when(~path, n))


def resolve(raw: DataFrame, functions: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Raw calls with callee_id, qualified_callee, to_crate and cross_crate; unresolved ones keep nulls.

    The cascade is one join: each call's candidate keys are exploded with their rank, joined to the symbol table, and the best rank wins.
    """
    return resolved_by(with_targets(raw, imports), symbol_table(functions))


def with_targets(raw: DataFrame, imports: DataFrame | None) -> DataFrame:
    """Raw calls with ``target``, what the called name was imported as in its file."""
    if imports is None:
        return raw.withColumn("target", F.lit(None).cast("string"))
    table = imports.groupBy("file", F.col("local_name").alias("callee_name")).agg(F.max("target").alias("target"))
    return raw.join(table, ["file", "callee_name"], "left")


def resolved_by(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """``resolve`` for calls with targets, over the rows of a symbol table that their keys name."""
    tried = raw.select("call_id", F.posexplode(candidates()).alias("rank", "key")).filter("key is not null")
    found = tried.join(grown(symbols.withColumnRenamed("crate", "to_crate")), "key")
    best = found.groupBy("call_id").agg(F.min_by(F.struct("id", "qualified_name", "to_crate"), "rank").alias("s"))
    out = raw.drop("target").join(grown(best.select("call_id", F.col("s.id").alias("callee_id"), F.col("s.qualified_name").alias("qualified_callee"), F.col("s.to_crate").alias("to_crate"))), "call_id", "left")
    return out.withColumn("cross_crate", F.coalesce(F.col("to_crate") != F.col("crate"), F.lit(False)))


def call_edges(resolved: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges of resolved calls by (caller, callee, line), each once; unresolved ones match by (name, crate), to every such function.

    Repeats go before names are matched: what is grouped is a caller's line with a name, never the edges, which are as many as the callers of a name times its functions. A resolved
    call stands under its callee's name; where the same line also has an unresolved call of that name, the match gives its edge. Ids are unique."""
    rows = resolved.join(grown(functions.select(F.col("qualified_name").alias("caller"), F.col("id").alias("src"))), "caller")
    sure = rows.filter("callee_id is not null").select("src", "line", F.col("callee_id").alias("dst"))
    known = functions.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "crate")
    rest = rows.filter("callee_id is null and callee_name is not null and crate is not null").select("src", "line", F.lit(None).cast(known.schema["dst"].dataType).alias("dst"), "callee_name", "crate")
    named = sure.distinct().join(grown(known), "dst", "left").select(rest.columns).unionByName(rest)
    groups = named.groupBy("src", "line", "callee_name", "crate").agg(F.collect_set("dst").alias("dsts"), F.bool_or(F.col("dst").isNull()).alias("loose"))
    found = groups.filter("not loose").select("src", F.explode("dsts").alias("dst"), "line")
    return found.unionByName(groups.filter("loose").drop("dsts").join(grown(known.distinct()), ["callee_name", "crate"]).select("src", "dst", "line"))


def named_edges(raw: DataFrame, functions: DataFrame, imports: DataFrame | None = None, scope: str = "workspace") -> DataFrame:
    """(src, dst, line): ``call_edges`` of ``resolve`` for a caller that wants the edges alone, and drops repeats itself.

    A call carries what its edge needs and neither an id nor its file. It asks for its best name alone; only those that this misses are multiplied by their other names. The answers are
    written to the shared folder, since those found and those missed are two plans, and each would shuffle all calls. ``scope`` crate: another crate's function is no answer."""
    spark = raw.sparkSession
    row = ["caller", "callee_name", "crate", "module", "line", "target"]
    asked = with_targets(raw.filter("callee_name is not null"), imports).select(*row, F.array_compact(candidates())[0].alias("key"))
    symbols = grown(symbol_table(functions).select("key", F.struct("id", "crate").alias("s")))
    at = scratch(spark, "asked")
    first = asked.join(symbols, "key", "left").select(*row, "s")
    first.write.option("compression", "zstd").parquet(at)
    release(spark)
    first = spark.read.schema(first.schema).parquet(at)
    missed = first.filter("s is null").select(*row, F.posexplode(F.array_compact(candidates())).alias("rank", "key")).filter("rank > 0")
    later = missed.join(symbols, "key", "left").groupBy(*row).agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("rank"))).alias("s"))
    answer = F.when(F.col("s.crate") == F.col("crate"), F.col("s.id")) if scope == "crate" else F.col("s.id")
    by_name = grown(functions.select(F.col("qualified_name").alias("caller"), F.col("id").alias("src")))
    of = lambda df: df.select("caller", "line", "callee_name", "crate", answer.alias("dst"))
    ends = of(first.filter("s is not null")).unionByName(of(later))
    sure = ends.filter("dst is not null").select("caller", "line", "dst").join(by_name, "caller").select("src", "dst", "line")
    known = functions.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "crate").distinct()
    rest = ends.filter("dst is null and crate is not null").select("caller", "line", "callee_name", "crate").distinct().join(by_name, "caller")
    return sure.unionByName(rest.join(grown(known), ["callee_name", "crate"]).select("src", "dst", "line"))


def call_ends(resolved: DataFrame, functions: DataFrame, *more: str) -> DataFrame:
    """The edges of each call, with further columns of the calls."""
    by_name = functions.select(F.col("qualified_name").alias("caller"), F.col("id").alias("src"))
    rows = resolved.join(grown(by_name), "caller")
    sure = rows.filter("callee_id is not null").select("src", F.col("callee_id").alias("dst"), "line", *more)
    loose = functions.select(F.col("name").alias("callee_name"), "crate", F.col("id").alias("dst"))
    rest = rows.filter("callee_id is null").join(grown(loose), ["callee_name", "crate"]).select("src", "dst", "line", *more)
    return sure.unionByName(rest)


def synthetic_edges(calls: DataFrame, functions: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(edges, functions to be created) of synthetic calls (src, target): the exact name, else its last parts (in the call's ``crate`` first, where it
    names one), else a new function."""
    exact = functions.groupBy(F.col("qualified_name").alias("target")).agg(F.min("id").alias("exact"))
    parts = F.split("target", "::")
    tail = F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(most)), F.lit(most)), "::")
    ends = suffixes(functions, most)
    rows = calls.join(exact, "target", "left").withColumn("suffix", tail).join(ends.groupBy("suffix").agg(F.min("id").alias("loose")), "suffix", "left")
    hit = F.coalesce("exact", "loose")
    if "crate" in calls.columns:
        own = ends.join(functions.select("id", "crate"), "id").groupBy("suffix", "crate").agg(F.min("id").alias("near"))
        rows, hit = rows.join(own, ["suffix", "crate"], "left"), F.coalesce("exact", "near", "loose")
    how = F.when(F.col("exact").isNotNull(), "exact").when(hit.isNotNull(), "suffix").otherwise("created")
    edges = rows.select("src", "target", hit.alias("dst"), how.alias("how"), *[c for c in calls.columns if c not in ("src", "target")])
    new = rows.filter(hit.isNull()).select(F.col("target").alias("qualified_name")).distinct()
    created = new.select("qualified_name", F.element_at(F.split("qualified_name", "::"), -1).alias("name"), F.split("qualified_name", "::")[0].alias("crate"), F.lit(True).alias("is_synthetic"), F.lit(False).alias("is_test"))
    return edges, created


def associated(raw: DataFrame, types: DataFrame, functions: DataFrame) -> DataFrame:
    """Type::method over crates: the last two parts name a type and one of its functions; the first crate in order wins."""
    parts = F.split("callee_name", "::")
    rows = raw.filter(F.col("callee_name").contains("::")).select("call_id", F.element_at(parts, -2).alias("type_name"), F.element_at(parts, -1).alias("method"))
    of = F.element_at(F.split("qualified_name", "::"), -2)  # the part before a method's name is its type
    methods = functions.filter(F.col("qualified_name").contains("::")).select("crate", of.alias("type_name"), F.col("name").alias("method"), "id")
    owned = methods.join(types.select(F.col("name").alias("type_name"), "crate").distinct(), ["crate", "type_name"], "left_semi")
    first = owned.groupBy("type_name", "method").agg(F.min(F.struct("crate", "id")).alias("s"))
    return rows.join(first, ["type_name", "method"], "left").select("call_id", F.col("s.crate").alias("to_crate"), F.col("s.id").alias("callee_id"))


# Methods of traits that code reaches without naming them.
TRAIT_METHODS = {
    "WebSocketActor": ("handle_message", "event_stream", "connect", "disconnect", "subscribe", "is_connected"),
    "Actor": ("on_start", "on_stop"),
    "Handler": ("handle",),
    "StreamHandler": ("handle", "started", "finished"),
    "Default": ("default",),
    "Clone": ("clone",),
    "Debug": ("fmt",),
    "Display": ("fmt",),
    "PartialEq": ("eq",),
    "Eq": (),
    "PartialOrd": ("partial_cmp",),
    "Ord": ("cmp",),
    "Hash": ("hash",),
    "From": ("from",),
    "Into": ("into",),
    "TryFrom": ("try_from",),
    "TryInto": ("try_into",),
    "AsRef": ("as_ref",),
    "AsMut": ("as_mut",),
    "Deref": ("deref",),
    "DerefMut": ("deref_mut",),
    "Iterator": ("next",),
    "IntoIterator": ("into_iter",),
    "Serialize": ("serialize",),
    "Deserialize": ("deserialize",),
}
#: Not of that table: traits whose methods operators, scopes and awaits reach.
MORE_TRAIT_METHODS = {
    "Drop": ("drop",), "FromStr": ("from_str",), "Future": ("poll",), "Add": ("add",), "Sub": ("sub",), "Mul": ("mul",), "Div": ("div",), "Message": ("handle",),
}


def trait_dispatch(impls: DataFrame, confidence: float = 0.8, more: bool = False) -> DataFrame:
    """Synthetic calls to the methods of known traits, from their implementations; ``more``: of the further traits too."""
    spark, known = impls.sparkSession, TRAIT_METHODS | (MORE_TRAIT_METHODS if more else {})
    fixed = spark.createDataFrame([(t, m) for t, ms in known.items() for m in ms], "trait_name string, method string")
    rows = impls.join(F.broadcast(fixed), "trait_name")  # a fixed table
    caller = F.concat_ws("::", F.lit("trait_caller"), "trait_name", "method")
    return rows.select(
        "crate", "file", "line", caller.alias("caller"), F.concat_ws("::", "type_name", "method").alias("name"), F.concat_ws("::", "crate", "type_name", "method").alias("target"), F.lit(confidence).alias("confidence"), F.lit(True).alias("is_synthetic")
    )


def pattern_links(expansions: DataFrame, functions: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Macro expansions (macro_id, crate, pattern) to all functions of the crate that the pattern's ``::name(`` names."""
    rows = expansions.select("macro_id", "crate", method_of_pattern(F.col("pattern")).alias("name")).filter("name is not null")
    return rows.join(functions.select("crate", "name", F.col("id").alias("dst")), ["crate", "name"]).select("macro_id", "crate", "dst", F.lit(confidence).alias("confidence"))


def generated_calls(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """A synthetic call for each (pattern, name) of a crate: ``{}`` in the pattern stands for the name. Sure where the pattern has a path."""
    rows = patterns.join(names, "crate").withColumn("target", F.replace("pattern", F.lit("{}"), F.col("name")))
    return rows.select("crate", "target", F.when(F.col("pattern").contains("::"), 0.95).otherwise(0.7).alias("confidence")).distinct()


# The dispatching function, a text that its files hold, the method it calls, how sure that is.
FRAMEWORK_RULES = (
    *(("websocket_framework::websocket_dispatch", marker, method, 0.95) for marker in ("impl WebSocketActor", "WebSocketActor for ") for method in ("event_stream", "handle_message")),
    *(("actix_framework::lifecycle_dispatch", marker, method, 0.90) for marker in (".start()", "Actor::start", "actor.start") for method in ("started", "stopping", "stopped")),
)


def framework_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FRAMEWORK_RULES), "caller string, marker string, method string, confidence double")


def dispatched(functions: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Framework entry points: functions that a rule (marker, method, confidence, and other columns that are kept) names, in files whose text
    holds the marker."""
    more = [c for c in rules.columns if c not in ("marker", "method", "confidence")]
    marked = files.join(F.broadcast(rules), F.col("text").contains(F.col("marker"))).select("file", F.col("method").alias("name"), "confidence", *more).distinct()  # rules are configuration
    return functions.join(marked, ["file", "name"]).select("id", "qualified_name", "confidence", *more)


#: Lengths of the pieces by which texts find their patterns; a literal is found by the longest that it has.
PIECES = (3, 5, 7)
PIECE = PIECES[0]
#: A pattern with more alternatives than this is tried on all texts.
MOST_LITERALS = 8


def required_literals(pattern: str) -> tuple[str, ...]:
    """Texts of ``PIECE`` characters or more, one of which every match of the pattern holds; none where that is not known (no regard to case, or a form that this reader does
    not take). A pattern without alternatives has its longest one."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ()
    if tree.state.flags & ~(re.UNICODE | re.DOTALL | re.MULTILINE):
        return ()
    return _held(tree)


def _held(tree: Iterable) -> tuple[str, ...]:
    best, run, either = "", [], ()

    def close() -> None:
        nonlocal best
        best = max(best, "".join(run), key=len)
        run.clear()

    def walk(items: Iterable) -> None:
        nonlocal either
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(value))
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name == "ATOMIC_GROUP":
                walk(value)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                walk(value[2])
                close()
            elif name == "BRANCH":
                close()
                parts = [_held(x) for x in value[1]]
                if all(parts) and not either:
                    either = tuple(sorted({x for p in parts for x in p}))
            elif name != "AT":
                close()

    walk(tree)
    close()
    return (best,) if len(best) >= PIECE else either


def keyed_patterns(patterns: DataFrame) -> tuple[DataFrame, list[int], int]:
    """The patterns (configuration) with ``literals``, one of which their matches hold (none that holds another), and the longest piece of each in ``pieces``; an empty piece where
    there are none or too many. Also the lengths of pieces that occur, and the most pieces that a pattern has."""
    spark = patterns.sparkSession
    rows = []
    for r in patterns.select("regex").filter("regex is not null").distinct().collect():
        held = required_literals(r["regex"])
        least = [t for t in held if not any(o != t and o in t for o in held)]
        if len(least) > MOST_LITERALS:
            least = []
        rows.append((r["regex"], least, sorted({t[: max(n for n in PIECES if n <= len(t))] for t in least}) or [""]))
    keyed = patterns.join(F.broadcast(spark.createDataFrame(rows, "regex string, literals array<string>, pieces array<string>")), "regex")
    return keyed, sorted({len(x) for r in rows for x in r[2]} - {0}), max((len(r[2]) for r in rows), default=0)


def pattern_candidates(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file, text, family, name, regex): a file meets the patterns one of whose literals its text holds, and those without one. One pass over the files, no shuffle: the pieces of
    its text, each once, are joined with the patterns, each pattern by the first of its pieces that the text holds. A text's work does not grow with the number of patterns but by those that it meets."""
    patterns, lengths, most = keyed_patterns(patterns)
    keyed = patterns.select("*", F.posexplode("pieces").alias("place", "piece"))
    pieces = [F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    rows = files.select("file", "text", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *pieces))).alias("piece")).join(F.broadcast(keyed), "piece")
    holds = lambda c, k: F.contains(F.col("text"), F.try_element_at(c, F.lit(k)))
    before = reduce(lambda x, k: x | (F.col("place") >= k) & holds("pieces", k), range(1, most), F.lit(False))
    sure = reduce(lambda x, k: x | holds("literals", k), range(1, MOST_LITERALS + 1), F.size("literals") == 0)
    return rows.filter(F.col("text").isNotNull() & F.coalesce(sure, F.lit(False)) & ~before).select("file", "text", "family", "name", "regex")


def matched_patterns(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file, family, name) of the regular expressions that a file's text matches; patterns are configuration. See ``pattern_candidates``."""
    return pattern_candidates(files, patterns).filter(F.expr("text rlike regex")).select("file", "family", "name")


def checked_pattern(pattern: str, banned: Iterable[str] = ("(?R)", "(?0)", "\\1\\1"), longest: int = 1000) -> str:
    """The pattern, or ValueError: too long, or with a fragment that is banned as it stands."""
    if len(pattern) > longest:
        raise ValueError(f"pattern of {len(pattern)} characters; at most {longest} are allowed")
    for b in banned:
        if b in pattern:
            raise ValueError(f"pattern holds {b!r}")
    return pattern


#: Line numbers lie below two to this power.
LEVELS = 40


def line_bins(functions: DataFrame) -> DataFrame:
    """(file, level, bin, best): the functions' line ranges dealt to dyadic bins, of a bin the shortest function over it (struct of span and id).

    A range is the union of at most two bins of each level, all of whose lines it covers, so only the shortest range of a bin matters to a point."""
    low, high, k = F.col("line_start").cast("long"), F.col("line_end").cast("long") + 1, F.col("level")
    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(high - low, F.lit(1)) + 1)).cast("int") + 1))
    f = functions.filter("line_start <= line_end").select("file", F.struct((F.col("line_end") - F.col("line_start")).alias("span"), F.col("id").alias("function_id")).alias("own"), low.alias("low"), high.alias("high"), F.explode(levels).alias("level"))
    first, last = F.expr("shiftright(low + shiftleft(1L, level) - 1, level)"), F.expr("shiftright(high, level)")
    ends = F.array(F.when(first % 2 != 0, first), F.when(last % 2 != 0, last - 1))
    rows = f.filter(first < last).select("file", k, F.explode(F.array_compact(F.array_distinct(ends))).alias("bin"), "own")
    return rows.groupBy("file", "level", "bin").agg(F.min("own").alias("best"))


def containing(points: DataFrame, functions: DataFrame) -> DataFrame:
    """Each point (file, line) with the innermost function around it: a point asks the one bin of each level that covers it, so it meets as many rows
    as there are levels, however many functions the file has."""
    bins = line_bins(functions)
    top = bins.agg(F.max("level")).scalar()  # a subquery of the plan
    asked = points.select("file", F.col("line"), F.explode(F.sequence(F.lit(0), top)).alias("level")).withColumn("bin", F.expr("shiftright(cast(line as bigint), level)"))
    hit = asked.join(grown(bins), ["file", "level", "bin"])
    return hit.groupBy("file", "line").agg(F.min("best")["function_id"].alias("function_id"))


def consolidated(functions: DataFrame, near: int = 5) -> DataFrame:
    """(qualified_name, line_start, merged, is_trait_impl): a definition and those of its name that begin at most ``near`` lines after it are one; it is a
    trait's if one of them is. A later one begins anew, so a chain of small gaps does not grow without end.

    A gap of more than ``near`` lines always begins anew, so each name's sorted lines are cut there first; only the lines of one dense stretch are folded
    together, and a definition finds its stretch's rows by the line where it begins."""
    of = Window.partitionBy("qualified_name").orderBy("line_start")
    lines = functions.select("qualified_name", F.col("line_start").cast("long").alias("line"), F.coalesce("is_trait_impl", F.lit(False)).alias("of_trait"))
    lines = lines.groupBy("qualified_name", "line").agg(F.count("*").alias("n"), F.bool_or("of_trait").alias("of_trait"))
    new = F.col("line_start") - F.lag("line_start").over(of) > near
    dense = lines.withColumnRenamed("line", "line_start").withColumn("stretch", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(of))
    rows = dense.groupBy("qualified_name", "stretch").agg(F.array_sort(F.collect_list(F.struct("line_start", "n", "of_trait"))).alias("all"))
    empty = F.expr("cast(array() as array<struct<line_start:bigint,n:bigint,of_trait:boolean>>)")
    none = F.struct(empty.alias("done"), F.lit(None).cast("struct<line_start:bigint,n:bigint,of_trait:boolean>").alias("now"))

    def fold(a: Column, x: Column) -> Column:
        now = a["now"]
        more = F.struct(now["line_start"].alias("line_start"), (now["n"] + x["n"]).alias("n"), (now["of_trait"] | x["of_trait"]).alias("of_trait"))
        return (
            F.when(now.isNull(), F.struct(a["done"].alias("done"), x.alias("now")))
            .when(x["line_start"] - now["line_start"] <= near, F.struct(a["done"].alias("done"), more.alias("now")))
            .otherwise(F.struct(F.array_append(a["done"], now).alias("done"), x.alias("now")))
        )

    each = rows.select("qualified_name", F.explode(F.aggregate("all", none, fold, lambda a: F.array_append(a["done"], a["now"]))).alias("d"))
    return each.select("qualified_name", F.col("d.line_start").alias("line_start"), F.col("d.n").cast("int").alias("merged"), F.col("d.of_trait").alias("is_trait_impl"))


def free(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Merged rows without repeats: the first of each key."""
    k = free(rows, "_k")
    return rows.withColumn(k, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(k) == 1).drop(k)


def best_impls(impls: DataFrame) -> DataFrame:
    """One implementation block for each (file, line, type), one with a trait's name first."""
    return first_of(impls, ["file", "line", "type_name"], [F.col("trait_name").asc_nulls_last()])


def method_lookup(inherent: DataFrame, traits: DataFrame) -> DataFrame:
    """(type_name, method) -> id, a type's own methods before those of its traits."""
    rows = inherent.select("type_name", "method", "id", F.lit(0).alias("prio")).unionByName(traits.select("type_name", "method", "id", F.lit(1).alias("prio")))
    return rows.groupBy("type_name", "method").agg(F.min(F.struct("prio", "id")).alias("s")).select("type_name", "method", F.col("s.id").alias("id"), (F.col("s.prio") == 1).alias("by_trait"))


def methods_of(functions: DataFrame, impls: DataFrame) -> DataFrame:
    """(crate, type_name, method, id, trait_name): every method of every type, its own and those of its traits' implementations."""
    of = F.element_at(F.split("qualified_name", "::"), -2)
    f = functions.filter("context in ('RegularImpl', 'TraitImpl')").select("crate", "file", of.alias("type_name"), F.col("name").alias("method"), "id")
    named = impls.select("crate", "file", "type_name", "trait_name", F.explode("methods").alias("method")).distinct()
    return f.join(named, ["crate", "file", "type_name", "method"], "left").select("crate", "type_name", "method", "id", "trait_name")


def implements(impls: DataFrame, types: DataFrame) -> DataFrame:
    """Type -> trait edges by bare names."""
    t = types.select(F.col("name").alias("type_name"), F.col("id").alias("src"))
    x = types.filter("kind = 'Trait'").select(F.col("name").alias("trait_name"), F.col("id").alias("dst"))
    return impls.filter("trait_name is not null").join(t, "type_name").join(x, "trait_name").select("src", "dst").distinct()


def constructor_calls(macros: DataFrame, functions: DataFrame, *, module_like: str, name: str = "new") -> DataFrame:
    """Macros to the constructors in a crate's modules of a pattern."""
    f = functions.filter((F.col("name") == name) & F.col("module").rlike(module_like)).select("crate", F.col("id").alias("dst"))
    return macros.select("macro_id", "crate").distinct().join(grown(f.distinct()), "crate").select("macro_id", "dst")  # once each: an id has one crate


# How a pasted name is written, and the macro that pastes names of its own.
PASTE_PATTERNS = (
    r"define_indicator_enums!\s*\(",
    r"paste!\s*\{\s*\[\s*<\s*\$\w+\s*>\s*\]::\w+\s*\(",
    r"\[\s*<\s*\$\w+\s*>\s*\]::\w+\s*\(",
    r"paste!\s*\{\s*\[\s*<\s*\$\w+\s+\w+\s*>\s*\]::\w+\s*\(",
    r"\[\s*<\s*\$\w+\s+\w+\s*>\s*\]::\w+\s*\(",
)


def _tagged(values: Column, tag: object, tag_name: str, name: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(tag).alias(tag_name), x.alias(name)))


def paste_patterns(files: DataFrame) -> DataFrame:
    """(file, kind, pattern): what each of PASTE_PATTERNS finds in a file's text, over lines; ``kind`` counts them from 0."""
    found = [_tagged(F.regexp_extract_all("text", F.lit(p), F.lit(0)), k, "kind", "pattern") for k, p in enumerate(PASTE_PATTERNS)]
    return files.select("file", F.explode(F.concat(*found)).alias("p")).select("file", "p.kind", "p.pattern").distinct()


def pattern_names(files: DataFrame) -> DataFrame:
    """(file, source, name): names that macros may be run over: arguments of the macro that defines enumerations, variants of enumerations,
    and collections that loops go through."""
    text = F.col("text")
    given = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)define_indicator_enums![^(]*\((.*?)\);"), F.lit(1)), lambda x: F.split(x, ",")))
    names = F.filter(F.transform(given, lambda x: F.trim(F.when(x.contains(":"), F.split(x, ":")[0]).otherwise(x))), lambda x: x.rlike(r"^\w+$"))
    body = F.regexp_extract_all(text, F.lit(r"(?ms)^[ \t]*(?:pub )?enum\b[^\n]*\n(.*?)^[ \t]*\}[ \t]*$"), F.lit(1))
    variants = F.filter(F.transform(F.flatten(F.transform(body, lambda b: F.split(b, "\n"))), lambda x: F.trim(F.split(x, ",")[0])), lambda x: x.rlike(r"^\p{Lu}"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("for ") & x.contains(" in "))
    loops = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.regexp_extract(x, r"^.*? in\s+(\S+)", 1), r"\.(into_)?iter\(\)", "")), lambda x: x.rlike(r"^\w+$"))
    each = [_tagged(a, s, "source", "name") for s, a in (("macro", names), ("enum", variants), ("loop", loops))]
    return files.select("file", F.explode(F.concat(*each)).alias("n")).select("file", "n.source", "n.name").distinct()


def indicator_names(macros: DataFrame) -> DataFrame:
    """(crate, name): capitalised words in macro arguments."""
    return macros.select("crate", F.explode(F.regexp_extract_all("arguments", F.lit(r"\b([A-Z][A-Za-z0-9]+)\b"), F.lit(1))).alias("name")).distinct()

"""Actors, messages and spawns: joins, details, routes, diagrams and reports.

Names and ids: ``spawns`` (parent, child), ``sends`` (sender, receiver) and ``handles`` (actor) refer to actors by ``id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators.predicates import false_or_null, topk
from symloom.operators.resolve import first_of, free


def named(actors: DataFrame, key: str, prefix: str) -> DataFrame:
    return actors.select(F.col("id").alias(key), F.col("name").alias(f"{prefix}_name"), F.col("crate").alias(f"{prefix}_crate"))


def spawn_edges(actors: DataFrame, spawns: DataFrame) -> DataFrame:
    """Spawns both of whose ends are known actors."""
    return spawns.join(named(actors, "parent", "parent"), "parent").join(named(actors, "child", "child"), "child")


def handle_edges(actors: DataFrame, handles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handles of all actors, actors that only a handler names, to be created)."""
    new = handles.select(F.col("actor").alias("id")).distinct().join(actors.select("id"), "id", "left_anti")
    created = new.select("id", F.concat(F.lit("actor-"), F.col("id").cast("string")).alias("name"), F.lit("unknown").alias("crate"), F.lit(False).alias("is_distributed"), F.lit(False).alias("is_test"))
    known = actors.select("id", "name", "crate", "is_distributed", "is_test").unionByName(created)
    return handles.join(known.select(F.col("id").alias("actor"), "name", "crate"), "actor"), created


def send_edges(actors: DataFrame, functions: DataFrame | None, sends: DataFrame, *, method: str | None = None) -> DataFrame:
    """Sends with the sender's name from the actors, else from the functions; unknown senders and messages are skipped."""
    rows = sends.filter("message_type is not null and message_type <> 'Unknown'")
    if method is not None:
        rows = rows.filter(F.lower("method") == method.lower())
    own, other = free(rows, "_actor"), free(rows, "_function")
    rows = rows.join(actors.select(F.col("id").alias("sender"), F.col("name").alias(own)), "sender", "left")
    if functions is not None:
        rows = rows.join(functions.select(F.col("id").alias("sender"), F.col("name").alias(other)).dropDuplicates(["sender"]), "sender", "left")
    else:
        rows = rows.withColumn(other, F.lit(None).cast("string"))
    return rows.withColumn("sender_name", F.coalesce(own, other)).filter("sender_name is not null").drop(own, other)


def distributed_edges(actors: DataFrame, sends: DataFrame) -> DataFrame:
    """Sends whose receiver is a distributed actor."""
    far = named(actors.filter("is_distributed"), "receiver", "receiver")
    return sends.join(far, "receiver").join(named(actors, "sender", "sender"), "sender")


def routes(actors: DataFrame, sends: DataFrame, handles: DataFrame, *, same_crate: bool = True) -> DataFrame:
    """sender -> message -> receiver of a message type that the receiver handles, each once; actors of one name and crate are one end.

    Distinct (sender, message) pairs are joined to handlers on message and, for routes within a crate, on the crate, so a very
    common message type is spread over crates. Routes are as many as senders times receivers while both tables are small, so their
    sizes show nothing of the work: the keys are dealt to a fixed number of tasks, which are not merged for being small.
    """
    of, n = actors.select("id", "name", "crate"), int(actors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(rows: DataFrame, actor: str, name: str) -> DataFrame:
        named = rows.select(F.col(actor).alias("id"), "message_type").distinct().join(of, "id")
        ends = named.select(F.col("name").alias(name), F.col("crate").alias(f"{name}_crate"), "message_type")
        return ends.repartition(n, "message_type", *[f"{name}_crate"] * same_crate).distinct()

    out, into = side(sends, "sender", "sender"), side(handles, "actor", "receiver")
    on = (out["message_type"] == into["message_type"]) & ((out["sender_crate"] == into["receiver_crate"]) if same_crate else F.lit(True))
    return out.join(into, on).select("sender", "sender_crate", out["message_type"], "receiver", "receiver_crate")


def potential_communications(sends: DataFrame, handles: DataFrame) -> DataFrame:
    """Each message type with its numbers of senders and receivers; either may be none."""
    types = sends.select("message_type").union(handles.select("message_type")).distinct()
    s = sends.groupBy("message_type").agg(F.countDistinct("sender").alias("senders"))
    h = handles.groupBy("message_type").agg(F.countDistinct("actor").alias("receivers"))
    return types.join(s, "message_type", "left").join(h, "message_type", "left").select("message_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("senders", "receivers")])


def message_links(sends: DataFrame, handles: DataFrame) -> DataFrame:
    """(actor, message_type, kind): the union of the two edge kinds."""
    return sends.select(F.col("sender").alias("actor"), "message_type", F.lit("SENDS").alias("kind")).distinct().union(handles.select("actor", "message_type", F.lit("HANDLES")).distinct())


def details(actors: DataFrame, sends: DataFrame, handles: DataFrame, spawns: DataFrame, methods: DataFrame | None = None, fields: DataFrame | None = None, implements: DataFrame | None = None) -> DataFrame:
    """Each actor with its distinct neighbours. ``methods``, ``fields`` and ``implements`` are (id, name) rows of actors; without them the lists are empty.

    Every edge table is aggregated before the joins, so lists do not multiply.
    """
    none = actors.select("id", F.lit(None).cast("string").alias("name")).limit(0)
    lists = lambda df, key, col, name: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(col)).alias(name))
    out = actors
    for part in (
        lists(spawns, "parent", "child", "spawns"),
        lists(spawns, "child", "parent", "spawned_by"),
        lists(sends, "sender", "message_type", "sends"),
        lists(handles, "actor", "message_type", "handles"),
        lists(sends, "sender", "receiver", "sends_to"),
        lists(sends, "receiver", "sender", "receives_from"),
        lists(methods if methods is not None else none, "id", "name", "methods"),
        lists(fields if fields is not None else none, "id", "name", "fields"),
        lists(implements if implements is not None else none, "id", "name", "implements"),
    ):
        out = out.join(part, "id", "left")
    text = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x.cast("string")), ",").alias(c)
    return out.select("id", "name", "crate", "is_distributed", *map(text, ("methods", "fields", "spawns", "spawned_by", "sends", "handles", "sends_to", "receives_from", "implements")))


def distributed(actors: DataFrame, *, crate: str | None = None, exclude_tests: bool = False, limit: int | None = 50) -> DataFrame:
    rows = actors.filter("is_distributed")
    if crate is not None:
        rows = rows.filter(F.col("crate") == crate)
    if exclude_tests:
        rows = rows.filter(false_or_null("is_test"))
    return topk(rows.select("id", "name", "crate"), [F.col("name")], ["id"], limit)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key, the newer columns first where they are not null; new keys are added. Both sides hold a key once."""
    rest = [c for c in old.columns if c not in key]
    return old.alias("o").join(new.alias("n"), key, "full_outer").select(*key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in rest])


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return first_of(rows, key, [F.desc(c) for c in order])


def spawn_diagram(actors: DataFrame, spawns: DataFrame) -> DataFrame:
    """One row: a ``graph TD`` of distinct spawn edges. The edges of a diagram are a report; they are listed in one string."""
    e = spawn_edges(actors, spawns).select("parent_name", "child_name").distinct()
    line = F.format_string("    %s --> %s", F.replace("parent_name", F.lit("#"), F.lit("_")), F.replace("child_name", F.lit("#"), F.lit("_")))
    return _diagram(e.select(line.alias("line")), "graph TD")


def message_diagram(actors: DataFrame, sends: DataFrame, *, method: str | None = None) -> DataFrame:
    rows = send_edges(actors, None, sends, method=method).join(named(actors, "receiver", "receiver"), "receiver")
    e = rows.groupBy("sender_name", "receiver_name", "message_type").agg(F.count_if(F.lower("method") == "tell").alias("tell"), F.count_if(F.lower("method") == "ask").alias("ask"))
    clean = lambda c: F.replace(c, F.lit("#"), F.lit("_"))
    return _diagram(e.select(F.format_string("    %s -->|%s tell:%d ask:%d| %s", clean("sender_name"), "message_type", "tell", "ask", clean("receiver_name")).alias("line")), "graph LR")


def flow_diagram(actors: DataFrame, sends: DataFrame) -> DataFrame:
    e = distributed_edges(actors, sends).select("sender_name", "receiver_name", "message_type").distinct()
    clean = lambda c: F.replace(c, F.lit("#"), F.lit("_"))
    nodes = e.select(F.col("sender_name").alias("n")).union(e.select("receiver_name")).distinct().select(F.format_string("    %s", clean("n")).alias("line"))
    edges = e.select(F.format_string("    %s -->|%s| %s", clean("sender_name"), "message_type", clean("receiver_name")).alias("line"))
    return _diagram(nodes.union(edges), "graph LR")


def _diagram(lines: DataFrame, head: str) -> DataFrame:
    """Lines are dealt by ranges and joined there, so that a few long strings in order meet in the one row, and no list of lines is held or sorted."""
    dealt = lines.repartitionByRange("line").select(F.spark_partition_id().alias("p"), "line")
    parts = dealt.groupBy("p").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"), F.count("*").alias("n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"])
    return parts.agg(F.concat_ws("\n", F.lit(head), F.when(F.size(texts) == 0, F.array(F.lit(""))).otherwise(texts)).alias("diagram"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"))


def spawn_groups(actors: DataFrame, spawns: DataFrame, by: str = "parent") -> DataFrame:
    """Spawns by parent, child or any other column: count, distinct other ends, and advice for busy spawners."""
    other = "child" if by != "child" else "parent"
    g = spawns.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(other).alias("distinct_others"))
    advice = F.when(F.col("n") > 20, "consider a pool").when(F.col("distinct_others") == 1, "single kind").otherwise("ok")
    return g.withColumn("advice", advice)


def by_test_status(actors: DataFrame) -> DataFrame:
    return actors.groupBy("crate").agg(
        F.count("*").alias("total"), F.count_if(F.col("is_test")).alias("test_actors"), F.count_if(false_or_null("is_test")).alias("production"), F.count_if(F.col("is_distributed") & false_or_null("is_test")).alias("distributed_production")
    )


def handled_messages(actors: DataFrame, handles: DataFrame) -> DataFrame:
    got = handles.groupBy(F.col("actor").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("message_type")), ",").alias("messages"), F.count("*").alias("n"))
    return actors.join(got, "id").select("id", "name", "messages", "n")


def out_degree(actors: DataFrame, sends: DataFrame, handles: DataFrame, spawns: DataFrame) -> DataFrame:
    edges = sends.select(F.col("sender").alias("id")).union(handles.select("actor")).union(spawns.select("parent"))
    return actors.select("id", "name").join(edges.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def local_and_distributed(actors: DataFrame, sends: DataFrame) -> DataFrame:
    a = actors.agg(F.count_if(~F.col("is_distributed")).alias("local_actors"), F.count_if("is_distributed").alias("distributed_actors"))
    f = sends.join(actors.select(F.col("id").alias("receiver"), "is_distributed"), "receiver").agg(F.count_if(~F.col("is_distributed")).alias("local_flows"), F.count_if("is_distributed").alias("distributed_flows"))
    return a.crossJoin(f)  # one row each


def merge_actor_types(types: DataFrame, actors: DataFrame) -> DataFrame:
    """One row for each (name, crate): a type that is an actor carries the actor's marks, actors without a type are added."""
    t = types.select("name", "crate", F.lit(True).alias("has_type"))
    a = actors.select("name", "crate", "is_distributed", F.lit(True).alias("is_actor"))
    return t.join(a, ["name", "crate"], "full_outer").select("name", "crate", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_type", "is_actor", "is_distributed")])


def migrate(types: DataFrame, actors: DataFrame, edges: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(types, edges) after the actors have become types: a type of an actor's name and crate carries its marks, an actor without one is a type of its own under its id, and every
    edge end that named an actor names its type. ``edges``: name -> (table, the columns that hold actors' ids). No actor is left beside its type."""
    a = actors.select("name", "crate", F.col("id").alias("actor_id"), "is_distributed", *[c for c in ("actor_type",) if c in actors.columns])
    kept = types.join(a.groupBy("name", "crate").agg(F.max("is_distributed").alias("is_distributed"), F.lit(True).alias("is_actor")), ["name", "crate"], "left")
    kept = kept.select("id", "name", "crate", F.coalesce("is_actor", F.lit(False)).alias("is_actor"), F.coalesce("is_distributed", F.lit(False)).alias("is_distributed"))
    alone = a.join(types.select("name", "crate"), ["name", "crate"], "left_anti").select(F.col("actor_id").alias("id"), "name", "crate", F.lit(True).alias("is_actor"), F.coalesce("is_distributed", F.lit(False)).alias("is_distributed"))
    of = a.join(types.groupBy("name", "crate").agg(F.min("id").alias("type_id")), ["name", "crate"]).select("actor_id", "type_id")
    moved = {}
    for name, (table, ends) in edges.items():
        out = table
        for end in ends:
            to = free(out, "_to")
            out = out.join(of.select(F.col("actor_id").alias(end), F.col("type_id").alias(to)), end, "left").withColumn(end, F.coalesce(to, end)).drop(to)
        moved[name] = out.select(table.columns).distinct()
    return kept.unionByName(alone), moved

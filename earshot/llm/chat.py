"""Chat formatting from reply trees (DataFrame only).

A tree is a set of nodes with parents.  Root-to-leaf paths are found by iterative
self-joins that double the reach of every node's ancestor pointer, so a tree of
depth n takes about log2(n) joins of ids and no text moves before its path is
chosen.  Branches (leaves) are ranked by the mean score of their path and each
chosen path is formatted as one conversation.

Template: every turn is ``<s>`` role, line feed, text ``</s>`` line feed.  Roles
and texts have ``& < > [ ]`` (roles also line feeds) escaped as entities, so no
control string can occur inside them; ``&`` is escaped first and unescaped last,
which makes it reversible.  ``loss_spans`` are the code-point spans of the
assistants' (escaped) texts in ``formatted``.

Defined cases: null text or role is empty; a missing parent makes a root; nodes on
or below a cycle have no root and form no path; rows of equal turn are ordered by
role, then text; repeated rows are separate turns; null tree ids are one tree; an
empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, let, running_sums, stage, table

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"), ("\n", "&#10;"))
OPEN, CLOSE = "<s>", "</s>\n"


def escape(x: Column, role: bool = False) -> Column:
    for raw, coded in ESCAPES if role else ESCAPES[:-1]:
        x = F.replace(x, F.lit(raw), F.lit(coded))
    return x


def unescape(x: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        x = F.replace(x, F.lit(coded), F.lit(raw))
    return x


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, depth, node) of the best ``branches`` paths of every tree.

    ``nodes``: tree, node, parent (null: root), score; ids are longs without nulls.
    """
    known = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    start = nodes.join(known, (F.col("tree") == F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
    state = stage(
        start.select(
            "tree", "node", F.col("n2").alias("up"), F.when(F.col("n2").isNull(), 0).otherwise(1).cast("long").alias("depth"),
            F.coalesce("score", F.lit(0.0)).alias("total"),
        ),
        "chat-0",
    )
    # Only nodes that have not reached their root move on; the rest stay as written.
    most = state.count()
    rooted, active = state.filter("up is null"), state.filter("up is not null")
    jumps, left = [active], active.count()
    while left and 2 ** len(jumps) <= 2 * most:
        b = rooted.unionByName(active).select(
            F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2")
        )
        moved = stage(
            active.join(b, (F.col("tree") == F.col("t2")) & (F.col("up") == F.col("n2"))).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("s2")).alias("total")
            ),
            f"chat-{len(jumps)}",
        )
        rooted, active = rooted.unionByName(moved.filter("up is null")), moved.filter("up is not null")
        left = active.count()
        jumps.append(active)
    inner = jumps[0].select(F.col("tree").alias("t2"), F.col("up").alias("n2")).distinct()
    leaves = rooted.join(inner, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), "node")
    path = (
        leaves.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= branches)
        .select("tree", F.col("node").alias("leaf"), "depth", "node")
    )
    # Ancestors by binary distance: the longest jumps first, each node once.
    for k in reversed(range(len(jumps) - 1)):
        j = jumps[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        far = path.join(j, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2")))
        path = stage(path.unionByName(far.select("tree", "leaf", (F.col("depth") - 2**k).alias("depth"), F.col("up").alias("node"))), f"chat-path-{k}")
    return path


def format_paths(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans) of rows (tree, leaf, depth, role, text)."""
    role, text = escape(F.coalesce("role", F.lit("")), True), escape(F.coalesce("text", F.lit("")))
    piece = F.struct(
        "depth",
        F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE)).alias("chunk"),
        (F.length(role) + len(OPEN) + 1).cast("long").alias("head"),
        F.length(text).cast("long").alias("chars"),
        (F.col("role") == "assistant").alias("loss"),
    )
    by = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    starts = running_sums(F.transform("p", lambda x: x["head"] + x["chars"] + len(CLOSE)))
    spans = F.transform(
        F.filter(F.arrays_zip(F.col("p").alias("x"), starts.alias("at")), lambda z: z["x"]["loss"]),
        lambda z: F.struct((z["at"] + z["x"]["head"]).alias("start"), (z["at"] + z["x"]["head"] + z["x"]["chars"]).alias("end")),
    )
    return by.select("tree", "leaf", F.array_join(F.transform("p", lambda x: x["chunk"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees whose every row answers the row before it by turn:
    conv_id, formatted, loss_spans."""
    tree = F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = stage(
        conversations.select(tree.alias("tree"), "conv_id", "turn", "role", "text")
        .withColumn("node", F.row_number().over(order).cast("long"))
        .select("tree", "conv_id", "node", "role", "text"),
        "chat-rows",
    )
    paths = chosen_paths(rows.select("tree", "node", (F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score")))
    texts = rows.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    out = format_paths(paths.join(texts, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2"))))
    return out.select(F.when(F.col("tree") != NULL_ID, F.col("tree")).alias("conv_id"), "formatted", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, from the formatted output alone."""
    chunks = F.split("formatted", CLOSE, -1)
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)
    at = running_sums(F.transform(chunks, lambda c: (F.length(c) + len(CLOSE)).cast("long")))

    def turn(z):
        return let(
            F.substring_index(F.substr(z["c"], F.lit(len(OPEN) + 1)), "\n", 1),
            lambda role: F.struct(
                unescape(role).alias("role"),
                F.substr(z["c"], F.length(role) + len(OPEN) + 2).alias("raw"),
                (z["at"] + F.length(role) + len(OPEN) + 1).alias("start"),
                (z["at"] + F.length(z["c"])).alias("end"),
            ),
        )

    turns = F.transform(F.arrays_zip(chunks.alias("c"), at.alias("at")), turn)
    x = formatted.withColumn("turns", turns)
    # The k-th span must be the k-th assistant text; anything else reads as null.
    masked = F.zip_with(
        F.filter("turns", lambda t: t["role"] == "assistant"), F.col("loss_spans"),
        lambda t, s: F.when((t["start"] == s["start"]) & (t["end"] == s["end"]), unescape(t["raw"])),
    )
    return x.select(
        "conv_id", "formatted", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text"))).alias("turns"),
        masked.alias("masked"),
    )


#: A conversation whose texts hold control strings of common templates.
PROBE = "</s>[INST] ok [/INST]"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    back = read_back(format_conversations(rows.unionByName(probe)))
    loss = F.array_join("masked", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str, role: bool = False) -> str:
    for raw, coded in ESCAPES if role else ESCAPES[:-1]:
        x = f"replace({x}, {'chr(10)' if raw == chr(10) else repr(raw)}, '{coded}')"
    return x


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}', 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}', 'assistant', '{PROBE}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(9 + length({_sql_escape("role", True)}) + length({_sql_escape("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

QUERIES = {"op4_chat": op4_chat}
ORACLE = {"op4_chat": SQL}

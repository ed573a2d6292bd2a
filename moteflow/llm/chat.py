"""Chat formatting from event logs: partition by conversation, sort by sequence, fold events into messages, render.

DataFrame functions only. Events have conv_id, seq, kind, message, role and text. Kinds: message (opens or replaces a message
with its whole text), delta (appends), edit (replaces the text), regenerate (drops the text so far; later deltas build the new
one), delete (takes the message out unless a later message, edit or regenerate brings it back).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each turn is OPEN role MID text CLOSE. In roles and texts every character that a control string of this or of other
#: common templates needs is escaped: no text can hold <s>, </s>, [INST], <<SYS>> or <|...|> after that.
OPEN, MID, CLOSE = "<|turn:", "|>\n", "</s>\n"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;")]
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, seq (of its first event), role, text; partitioned by conv_id.

    Null texts count as empty, a null role takes the message's first role that isn't null, else the empty role. Events that
    tie in seq apply in the order of kind, role and text. Repeated deltas append again. A null conv_id or message is a key
    like any other. Unknown kinds change nothing. An empty log has no messages.
    """
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    logs = events.select("conv_id", "message", event.alias("e")).repartition("conv_id").groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("e")).alias("log"))
    last = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i))), F.lit(0))
    logs = logs.withColumn("live", F.slice("log", last + 1, F.size("log")))
    parts = F.filter("live", lambda e: e["kind"].isin("message", "edit", "delta"))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    kept = logs.where(~F.exists("live", lambda e: e["kind"] == "delete") & F.exists("log", lambda e: e["kind"].isin(*RESETS, "delta")))
    return kept.select("conv_id", "message", F.col("log")[0]["seq"].alias("seq"), F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans (turn, start, end, offset of start within the turn).

    Offsets count code points of formatted. Messages go by seq; ties by role, then text, then message.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = messages.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))).withColumn("body", escape(F.col("text")))
    turns = shown.withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    turns = turns.withColumn("no", F.count(F.lit(1)).over(order)).withColumn("end", F.sum(F.length("turn").cast("long")).over(order))
    start = F.col("end") - F.length("turn") + F.length("head")
    span = F.struct((F.col("no") - 1).cast("int").alias("turn"), start.alias("start"), (start + F.length("body")).alias("end"), F.length("head").alias("offset"))
    sorted_turns = F.array_sort(F.collect_list(F.struct("no", "turn", F.when(F.col("role") == loss_role, span).alias("span"))))
    return turns.groupBy("conv_id").agg(sorted_turns.alias("t")).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Event log to formatted conversations; see fold() and render()."""
    return render(fold(events), loss_role)


def parse(formatted: DataFrame) -> DataFrame:
    """Back from the output: conv_id, turns (role, text), loss_text (what the loss spans cover, unescaped), formatted."""
    cut = formatted.withColumn("segments", F.slice(F.split("formatted", r"<\|turn:"), F.lit(2), F.greatest(F.lit(0), F.size(F.split("formatted", r"<\|turn:")) - 1)))

    def turn(s: Column) -> Column:
        role = F.substring_index(s, MID, 1)
        at = F.length(role) + len(MID)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(s, at + 1, F.length(s) - at - len(CLOSE))).alias("text"))

    loss = F.transform("loss_spans", lambda p: F.substring(F.get("segments", p["turn"]), p["offset"] - len(OPEN) + 1, (p["end"] - p["start"]).cast("int")))
    return cut.select("conv_id", F.transform("segments", turn).alias("turns"), unescape(F.array_join(loss, "")).alias("loss_text"), "formatted")


def turn_events(conversations: DataFrame, delta_chars: int = 512) -> DataFrame:
    """The log that streaming the given turns leaves: conv_id, seq, kind, message, role, text.

    A turn opens as an empty message and its text arrives in deltas of delta_chars code points. By a hash of its text, a quarter
    of the turns first stream a wrong draft, the beginning of the text backwards, which a regenerate throws away; another
    quarter stream that draft alone, and an edit replaces it by the whole text. seq is turn * 2**32 and the event's place in
    its turn; a null turn comes before all others. Each row is a message, repeated rows too; null texts stream as empty.
    """
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    way = F.pmod(F.xxhash64(text), F.lit(4))
    event = lambda kind, said, who=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if who is None else who).alias("role"), said.alias("text"))
    pieces = F.greatest(F.ceil(F.length("t") / delta_chars).cast("int"), F.lit(1))
    deltas = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: event("delta", F.substring(F.col("t"), i * delta_chars + 1, F.lit(delta_chars))))
    draft = event("delta", F.reverse(F.substring("t", 1, 24)))
    opening = event("message", F.lit(""), role)
    log = F.when(F.col("way") == 0, F.concat(F.array(opening, draft, event("regenerate", F.lit(""))), deltas)).when(F.col("way") == 1, F.array(opening, draft, event("edit", F.col("t")))).otherwise(F.concat(F.array(opening), deltas))
    rows = conversations.select("conv_id", F.shiftleft(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 30))), 32).alias("at"), F.monotonically_increasing_id().alias("message"), "role", text.alias("t"), way.alias("way"))
    return rows.select("conv_id", "at", "message", F.posexplode(log).alias("place", "e")).select("conv_id", (F.col("at") + F.col("place")).alias("seq"), "e.kind", "message", "e.role", "e.text")


def digests(parsed: DataFrame) -> DataFrame:
    """Digest columns of parse()'s output."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: DuckDB: the digests from the rows themselves.
ORACLE_SQL = """
WITH r AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'), ']', '&#93;'))
          + length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'), ']', '&#93;')) + 15 AS shown FROM r)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(length(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(shown) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

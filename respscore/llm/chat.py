"""Chat formatting (operator 8) as relational work, Spark expressions only.

``format_conversations`` collects the turns of a conversation as structs,
sorts them, merges adjacent turns of one role into a block, and concatenates
the blocks into one string with a loss mask.  ``read_back`` parses such a
string into its turns again.  Control strings inside roles and texts are
broken by a backslash behind their first character (and a backslash is
doubled), so a text can never open, close or split a turn, and reading back
is exact.

Defined results: a null text or role is empty; turns with the same number are
ordered by role, then text; repeated rows are repeated turns; a null turn
number comes first; rows with a null conversation form one conversation; an
empty table gives an empty result.  A conversation becomes one string, so one
conversation must fit a row; different ones never meet in a group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table


@dataclass(frozen=True)
class Template:
    """Control strings: block = open role mid text (sep text)* close."""
    open: str = "[INST] "
    mid: str = " [/INST]"
    sep: str = "<s>"
    close: str = "</s>"
    loss_role: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(s.strip() for s in (self.open, self.mid, self.sep, self.close)))

    @property
    def escapes(self) -> str:
        """Pattern of the characters that get a backslash behind them (same in Java's and RE2-like engines but the lookahead)."""
        return r"\\|" + "|".join(f"{_lit(c[0])}(?={_lit(c[1:])})" for c in self.controls)


TEMPLATE = Template()


def _lit(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, F.lit(t.escapes), F.lit("$0\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _blocks(turns: Column) -> Column:
    """Runs of one role among sorted turns: array of struct(role, texts)."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(starts, lambda s: F.transform(s, lambda a, k: F.struct(
        F.get(turns, a)["role"].alias("role"),
        F.transform(F.slice(turns, a + 1, F.coalesce(F.get(s, k + 1), n) - a), lambda x: x["text"]).alias("texts"))))


def _pieces(blocks: Column, t: Template) -> Column:
    """Array of struct(head, body, loss): what stands before each escaped text, the text, and whether it counts for the loss."""
    return F.flatten(F.transform(blocks, lambda b, k: F.transform(b["texts"], lambda x, i: F.struct(
        F.when(i > 0, F.lit(t.sep)).otherwise(
            F.concat(F.when(k > 0, F.lit(t.close)).otherwise(F.lit("")), F.lit(t.open), escape(b["role"], t), F.lit(t.mid))).alias("head"),
        escape(x, t).alias("body"), (b["role"] == t.loss_role).alias("loss")))))


def _spans(pieces: Column) -> Column:
    """(start, length) in code points of the texts that count for the loss, in order."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.struct(start.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((start + F.length(p["body"])).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def format_conversations(rows: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (code point start and length of each text that
    counts for the loss) from rows of ``conv_id, turn, role, text``.

    One shuffle, which carries each text once; turns are collected by task first."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))

    def whole(pieces: Column) -> Column:
        parts = F.transform(pieces, lambda p: F.concat(p["head"], p["body"]))
        return F.struct(F.concat(F.array_join(parts, ""), F.lit(t.close)).alias("formatted"), _spans(pieces).alias("loss_spans"))

    built = let(_blocks(F.col("_turns")), lambda b: let(_pieces(b, t), whole))
    return convs.select("conv_id", F.inline(F.array(built)))


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """Array of struct(role, text): the turns that a formatted string holds, unescaped."""
    quote = lambda s: rf"\Q{s}\E"
    body = F.substring(formatted, F.lit(1), F.length(formatted) - len(t.close))
    return F.flatten(F.transform(F.split(body, quote(t.close)), lambda b: let(
        F.split(F.substr(b, F.lit(len(t.open) + 1)), quote(t.mid), 2),
        lambda rt: F.transform(F.split(F.get(rt, F.lit(1)), quote(t.sep)),
                               lambda x: F.struct(unescape(F.get(rt, F.lit(0))).alias("role"), unescape(x).alias("text"))))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_conversations(rows.unionByName(probe))
    digest = let(read_back(F.col("formatted")), lambda turns: F.struct(
        F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256")))
    loss = let(loss_text(F.col("formatted"), F.col("loss_spans")), lambda s: F.struct(
        F.length(s).cast("bigint").alias("loss_chars"), F.sha2(s, 256).alias("loss_sha256")))
    return out.select("conv_id", F.inline(F.array(digest)), "formatted", "loss_spans") \
        .select("conv_id", "n_turns", "turns_sha256", "formatted", F.inline(F.array(loss))) \
        .select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", F.length("formatted").cast("bigint").alias("formatted_chars"))


_N = "(length(X) - length(replace(X, '{0}', ''))) / {1}"
_ESCAPED = "(length(X) + " + " + ".join("(" + _N.format(c, len(c)) + ")::BIGINT" for c in ("\\", *TEMPLATE.controls)) + ")"
OP8_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
s AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
l AS (SELECT *, {_ESCAPED.replace('X', 'text')} AS body,
             CASE WHEN before = role THEN {len(TEMPLATE.sep)}
                  ELSE {len(TEMPLATE.close)} + {len(TEMPLATE.open)} + {len(TEMPLATE.mid)} + {_ESCAPED.replace('X', 'role')} END AS head FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(head + body)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

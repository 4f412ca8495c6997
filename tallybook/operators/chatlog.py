"""Chat-log preparation in bulk.

Conversations are rows ``(conv_id, turn, role, text)``.  Every operator is a
row expression or a bounded per-conversation step: the history tail keeps
at most ``k`` turns per conversation (skew-safe first-k), and messages are
assembled from that bounded tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.common import first_k

HISTORY_KEPT = 20
# Python's str.split()/strip() whitespace, as a Java regex class.
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The reference's result texts and follow-up.
NO_DATA = "ไม่พบข้อมูล"
FOLLOWUP_HEAD, FOLLOWUP_TAIL = "ผลลัพธ์จากฐานข้อมูล:\n", "\n\nกรุณาสรุปคำตอบเป็นภาษาไทยที่เข้าใจง่าย"
ERROR_PREFIX = "เกิดข้อผิดพลาด: "


# Every character Python's str.strip() removes, by str.isspace().
WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: whitespace at both ends (a character-set trim,
    no regular expression)."""
    return F.btrim(c, F.lit(WS_CHARS))


def role_map(role) -> Column:
    """Assistant -> model, anything else -> user."""
    r = F.col(role) if isinstance(role, str) else role
    return F.when(r == "assistant", F.lit("model")).otherwise(F.lit("user"))


def extract_sql(text) -> Column:
    """X11: the first ``<sql>...</sql>`` (across lines), stripped; none or empty -> NULL."""
    t = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_extract(t, r"(?s)<sql>(.*?)</sql>", 1)
    found = t.rlike(r"(?s)<sql>.*?</sql>")
    return F.when(found, F.nullif(strip_ws(inner), F.lit("")))


def answer_words(df: DataFrame, text: str = "text", keys=("conv_id", "turn")) -> DataFrame:
    """One chunk per whitespace-separated word, with a trailing blank."""
    words = F.filter(F.split(strip_ws(F.col(text)), f"{WS}+"), lambda x: x != "")
    return (df.select(*keys, F.posexplode(words).alias("pos", "word"))
              .select(*keys, "pos", F.concat("word", F.lit(" ")).alias("chunk")))


def history_tail(conv: DataFrame, k: int = HISTORY_KEPT) -> DataFrame:
    """The last ``k`` messages of each conversation."""
    return first_k(conv, ["conv_id"], "turn", k, descending=True)


def _assembled(g: DataFrame, hist: Column, last_text: Column) -> DataFrame:
    """The message list from a history (array of role, text) and the last user text: the system text ``sys``
    goes, with a blank line between, before the first message, which always has role ``user``."""
    def msg(role, content):
        return F.struct(role.alias("role"), content.alias("content"))

    none = F.size(hist) == 0
    first = msg(F.lit("user"), F.concat("sys", F.lit("\n\n"), F.when(none, last_text).otherwise(F.try_element_at(hist, F.lit(1))["text"])))
    rest = F.transform(F.slice(hist, 2, F.greatest(F.size(hist) - 1, F.lit(0))), lambda x: msg(role_map(x["role"]), x["text"]))
    last = F.when(none, F.array()).otherwise(F.array(msg(F.lit("user"), last_text)))
    return (g.select("conv_id", F.posexplode(F.concat(F.array(first), rest, last)).alias("pos", "msg"))
             .select("conv_id", "pos", F.col("msg.role").alias("role"), F.col("msg.content").alias("content")))


def _last_turns(conv: DataFrame, k: int, *extra: Column) -> DataFrame:
    tail = first_k(conv, ["conv_id"], "turn", k + 1, descending=True)
    return tail.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), *extra)


def _said(x: Column) -> Column:
    return F.struct(x["role"].alias("role"), x["text"].alias("text"))


def message_assembly(conv: DataFrame, system_text: Column, k: int = HISTORY_KEPT) -> DataFrame:
    """First-round message list per conversation: its last turn is the
    question and up to ``k`` earlier turns the history.  As in the reference,
    the system text is prefixed (blank line between) to the first history
    message, or to the question when there is no history, and that first
    message always has role ``user``.  Output ``(conv_id, pos, role, content)``."""
    g = _last_turns(conv, k, F.first(system_text).alias("sys"))
    hist = F.transform(F.slice("m", 1, F.size("m") - 1), _said)
    return _assembled(g, hist, F.element_at("m", -1)["text"])


def followup(result: Column) -> Column:
    """The user text of the second round around the result text."""
    return F.concat(F.lit(FOLLOWUP_HEAD), result, F.lit(FOLLOWUP_TAIL))


def second_round(conv: DataFrame, system_text: Column, answers: DataFrame, k: int = HISTORY_KEPT,
                 keep_question: bool = False) -> DataFrame:
    """W4, second round: history, the model's first answer, and the follow-up with the result.

    ``answers`` is ``(conv_id, first_answer, result_text)``; conversations without an answer have no
    second round.  The reference's list leaves the question itself out (B16);
    ``keep_question`` puts it back before the first answer."""
    g = _last_turns(conv, k, F.first(system_text).alias("sys")).join(answers, "conv_id")
    hist = F.transform(F.slice("m", 1, F.size("m") - 1), _said)
    question = F.array(F.struct(F.lit("user").alias("role"), F.element_at("m", -1)["text"].alias("text")))
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.col("first_answer").alias("text")))
    return _assembled(g, F.concat(hist, question, answer) if keep_question else F.concat(hist, answer), followup(F.col("result_text")))


def result_text(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``(key, result_text)`` per question of ``asked(key, error)``: its rows ``(key, pos, row_json)`` as one
    JSON array in the order of ``pos``, the no-data text when there are none, or the error text.

    The text is one value by its purpose (it is handed to the answer writer whole), so a question's rows meet in one row."""
    got = rows.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("pos", "row_json"))).alias("_r"))
    body = F.concat(F.lit("[\n"), F.array_join(F.transform("_r", lambda x: x["row_json"]), ",\n"), F.lit("\n]"))
    return asked.join(got, F.col("key") == F.col("_key"), "left").select(
        "key", F.when(F.col("error").isNotNull(), F.concat(F.lit(ERROR_PREFIX), "error"))
        .when(F.col("_r").isNull(), F.lit(NO_DATA)).otherwise(body).alias("result_text"))


def _json_value(c: Column, dtype: str) -> Column:
    if dtype.startswith("decimal") or dtype in ("date", "timestamp"):
        c = c.cast("string")  # the reference serialises these with str()
    # a one-element JSON array, brackets removed, is the JSON text of the value
    t = F.to_json(F.array(c))
    return F.substring(t, 2, F.length(t) - 2)


def row_json(df: DataFrame, indent: int = 2) -> Column:
    """One result row as the reference's JSON object text (non-ASCII kept,
    ``indent=2`` inside the array)."""
    pad_k, pad_o = " " * (2 * indent), " " * indent
    parts = []
    for name, dtype in df.dtypes:
        key = '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '": '
        v = F.coalesce(_json_value(F.col(name), dtype), F.lit("null"))
        parts.append(F.concat(F.lit(pad_k + key), v))
    return F.concat(F.lit(pad_o + "{\n"), F.concat_ws(",\n", *parts), F.lit("\n" + pad_o + "}"))

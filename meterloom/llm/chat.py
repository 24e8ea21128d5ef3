"""Chat formatting: canonical turns from records of many layouts, one template, loss spans, and the way back.

**Layouts.** A record is a JSON object. Its fingerprint is a hash of its sorted nested field paths (``messages[].role``);
it selects a declarative mapping, which names where the turns or the single fields of the layout are. New layouts are new
rows of :data:`MAPPINGS`, not new code. Records whose fingerprint no mapping has come out with null turns and their
fingerprint, so none is lost.

**Template.** ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A control string starts with ``<|``. Inside roles and
texts each ``<`` + any number of backslashes + ``|`` gets one backslash more, so an escaped text has no ``<|``, and taking
one backslash away restores it exactly. Line ends in roles are written ``<|n|>``.

**Loss mask.** Spans (start, length in code points) of assistant texts inside the formatted string.

Defined results: null role or text counts as empty; a record without turns formats to an empty string; equal turn numbers
are ordered by role and text; the turns of one conversation are one value of one row, as its digest is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ROLE_LINE = "<|im_start|>", "<|im_end|>", "<|n|>"

#: layout name -> its field paths, and where its turns are: a list with role and text fields, or fixed roles of fields.
MAPPINGS = {
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": "messages", "role": "role", "text": "content"},
    "system_messages": {"paths": ["messages[].content", "messages[].role", "system"], "list": "messages", "role": "role", "text": "content",
                        "fields": [("system", "system")]},
    "share": {"paths": ["conversations[].from", "conversations[].value"], "list": "conversations", "role": "from", "text": "value", "rename": True},
    "system_share": {"paths": ["conversations[].from", "conversations[].value", "system"], "list": "conversations",
                     "role": "from", "text": "value", "fields": [("system", "system")], "rename": True},
    "prompt": {"paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    "chosen": {"paths": ["completion", "prompt"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    "instruction": {"paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"paths": ["input", "instruction", "output"],
                          "fields": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    "question": {"paths": ["answer", "question"], "fields": [("user", "question"), ("assistant", "answer")]},
}
#: Role names of layouts marked "rename" and their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1)}
TURNS = "array<struct<role:string,text:string>>"


def field_paths(record: Column) -> Column:
    """Sorted distinct paths ``key`` or ``key[].subkey`` of a JSON object."""
    top = F.from_json(record, "map<string,string>", JSON_OPTIONS)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(top), lambda e: F.when(
        F.ltrim(e["value"]).startswith("[{"),
        F.transform(
            F.array_distinct(F.flatten(F.transform(
                F.from_json(e["value"], "array<map<string,string>>", JSON_OPTIONS), lambda m: F.map_keys(m)))),
            lambda k: F.concat(e["key"], F.lit("[]."), k)),
    ).otherwise(F.array(e["key"]))))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, spec: dict) -> Column:
    """The turns of one layout; its fields first, then its list."""
    fields = [c for _, c in spec.get("fields", [])]
    types = [f"`{c}` string" for c in fields]
    if "list" in spec:
        types.append(f"`{spec['list']}` array<struct<`{spec['role']}`:string,`{spec['text']}`:string>>")
    parsed = F.from_json(record, ", ".join(types), JSON_OPTIONS)
    parts = [F.array(*[_turn(F.lit(role), parsed[c]) for role, c in spec["fields"]])] if fields else []
    if "list" in spec:
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        name = lambda r: F.coalesce(F.try_element_at(names, r), r) if spec.get("rename") else r
        parts.append(F.transform(parsed[spec["list"]], lambda m: _turn(name(m[spec["role"]]), m[spec["text"]])))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds ``fingerprint`` and ``turns``; a record of unknown layout gets null turns."""
    marked = records.withColumn("fingerprint", fingerprint(field_paths(F.col(record_col))))
    turns = F.lit(None).cast(TURNS)
    for spec in MAPPINGS.values():
        known = fingerprint(F.array(*[F.lit(p) for p in sorted(spec["paths"])]))
        turns = F.when(F.col("fingerprint") == known, _mapped(F.col(record_col), spec)).otherwise(turns)
    return marked.withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_turns(turns: Column) -> Column:
    """The formatted string of an array of turns."""
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit(ROLE_LINE))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """``array<struct<start, length>>``: where assistant texts are inside :func:`format_turns`, in code points from 0."""
    size = lambda t: F.length(format_turns(F.array(t)))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        span = F.struct((acc["at"] + F.lit(len(START) + 1) + F.length(F.lit("assistant"))).alias("start"), F.length(escape(t["text"])).alias("length"))
        return F.struct((acc["at"] + size(t)).alias("at"),
                        F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: acc["spans"])


def format_chats(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds ``turns``, ``formatted`` and ``loss`` (spans) to JSON records of any known layout."""
    return canonical_turns(records, record_col).withColumns({
        "formatted": format_turns(F.col("turns")), "loss": loss_spans(F.col("turns"))})


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: the inverse of :func:`format_turns`."""
    parts = F.filter(F.split(formatted, F.lit(r"\Q" + START + r"\E")), lambda p: p != "")

    def turn(p):
        cut = F.locate("\n", p)
        body = F.substring(p, cut + 1, F.length(p) - cut - F.lit(len(END) + 1))
        return F.struct(unescape(F.replace(F.substring(p, F.lit(1), cut - 1), F.lit(ROLE_LINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, cut from the formatted string and unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """``conv_id, record`` from rows ``conv_id, turn, role, text``: each conversation as JSON of the layout that fits it.

    A user and an assistant turn become a prompt record, a leading system turn the field beside a list, all others
    a list of messages.
    """
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    rest = F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(0)))
    options = {"ignoreNullFields": "false"}
    messages = lambda ts: F.transform(ts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return turns.select("conv_id", F.when(
        roles == F.array(F.lit("user"), F.lit("assistant")),
        F.to_json(F.struct(F.col("turns")[0]["text"].alias("prompt"), F.col("turns")[1]["text"].alias("response")), options),
    ).when(
        (roles[0] == "system") & (F.size("turns") > 1),
        F.to_json(F.struct(F.col("turns")[0]["text"].alias("system"), messages(rest).alias("messages")), options),
    ).otherwise(F.to_json(F.struct(messages("turns").alias("messages")), options)).alias("record"))

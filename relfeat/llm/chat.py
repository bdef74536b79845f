"""Chat formatting with schema fingerprints.

Records are JSON objects of different layouts.  A record's fingerprint is a hash of its sorted
nested field paths (``messages[].role`` ...); it selects a declarative mapping that says where the
turns are.  Canonical turns (role, text) are then written in one template:

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside texts are escaped reversibly (every ``<|`` gets a backslash more between
its two characters), so a text can never open or close a turn.  The loss mask is a list of
(start, length) spans of the formatted text, one for each assistant text.

Scale: records are converted where they lie; a record is one value, so no step holds more than a
batch of records.

Defined results: null texts and roles are empty; a record that is null, empty, broken, nested
deeper than the JSON reader goes, or that holds half of a surrogate pair gives null turns and the
status ``no_record``; one whose fingerprint no mapping is registered for, ``unknown_layout``; repeated records are formatted alike; extra columns are ignored; extra fields
of a record change its fingerprint, so they need a mapping of their own.
"""
from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
OUT = "status string, fingerprint string, formatted string, loss array<struct<start: long, length: long>>"


def escape_name(name: str) -> str:
    """A field's name inside a path: a backslash before what paths use themselves."""
    return re.sub(r"([\\.\[])", r"\\\1", name)


def field_paths(value) -> set[str]:
    """The nested paths of a JSON value's fields; ``[]`` stands for the entries of a list, ``[!]`` for
    a list without entries."""
    out, open_ = set(), [("", value)]
    while open_:  # no recursion: a record may be nested deeply
        path, v = open_.pop()
        if isinstance(v, dict) and v:
            open_ += [(f"{path}.{escape_name(k)}" if path else escape_name(k), x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            open_ += [(path + "[]", x) for x in v]
        else:
            out.add(path + "[!]" if isinstance(v, list) else path)
    return out


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Declarative mappings: a list of turns with its role and text fields (and other names of
#: roles), or single fields in the turns' order, several fields of a turn joined by a line end.
LAYOUTS = [
    {"list": "messages", "role": "role", "text": "content"},
    {"list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
    {"fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"fields": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
]


def layout_paths(layout: dict) -> set[str]:
    if "list" in layout:
        return {f"{escape_name(layout['list'])}[].{escape_name(layout[f])}" for f in ("role", "text")}
    return {escape_name(f) for _, fields in layout["fields"] for f in fields}


def registry(layouts=LAYOUTS) -> dict[str, dict]:
    out = {fingerprint(layout_paths(x)): x for x in layouts}
    for x in layouts:  # a list without entries has its own path
        if "list" in x:
            out[fingerprint({f"{escape_name(x['list'])}[!]"})] = x
    return out


def to_turns(record: dict, layout: dict) -> list[tuple[str, str]]:
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "list" in layout:
        names = layout.get("roles", {})
        return [(names.get(r := text(x.get(layout["role"])), r), text(x.get(layout["text"]))) for x in record[layout["list"]]]
    return [(role, "\n".join(t for i, f in enumerate(fields) if (t := text(record.get(f))) or not i)) for role, fields in layout["fields"]]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted text and the spans of the assistant's texts, in code points."""
    out, at, loss = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            loss.append({"start": at + len(head), "length": len(body)})
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def convert_record(source: str | None, known: dict[str, dict]) -> tuple:
    """(status, fingerprint, formatted, loss) of a JSON record."""
    record = json.loads(source) if source else None
    if not isinstance(record, dict):
        return "no_record", None, None, None
    print_ = fingerprint(field_paths(record))
    if print_ not in known:
        return "unknown_layout", print_, None, None
    formatted, loss = format_turns(to_turns(record, known[print_]))
    formatted.encode("utf-8")  # raises for half a surrogate pair
    return "ok", print_, formatted, loss


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts=LAYOUTS) -> DataFrame:
    """``id, status, fingerprint, formatted, loss`` of each JSON record."""
    known = registry(layouts)
    slim = records.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))

    def convert(batches):
        for batch in batches:
            rows = []
            for source in batch.column("record").to_pylist():
                try:
                    rows.append(convert_record(source, known))
                except (ValueError, RecursionError):  # not JSON, half a surrogate pair, or nested too deeply
                    rows.append(("no_record", None, None, None))
            columns = list(zip(*rows)) or [[]] * 4
            loss = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [loss])],
                                             names=["id", "status", "fingerprint", "formatted", "loss"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(convert, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


def chat_digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted text says, read back: ``id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``; null for records that were not formatted."""
    slim = chats.select(F.col(id_col).alias("id"), "formatted", "loss")

    def read(batches):
        for batch in batches:
            rows = []
            for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                if formatted is None:
                    rows.append((None,) * 5)
                    continue
                turns = read_turns(formatted)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                learnt = "".join(unescape(formatted[s["start"]:s["start"] + s["length"]]) for s in loss)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(read, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows (conv_id, turn, role, text): a stand-in for landed files.  The
    layout follows from the conversation's roles and id.  A conversation is one record, as in a
    file of records, so its rows meet in one group."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    keep = {"ignoreNullFields": "false"}
    text = lambda i: F.col("t")[i]["text"]
    spread = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    share = F.forall(roles, lambda r: r.isin("system", "user", "assistant")) & (spread < 2)
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    return chats.select("conv_id", F.when(pair & (spread == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")), keep))
                        .when(pair & (spread == 1), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")), keep))
                        .when(pair & (spread == 2), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output")), keep))
                        .when(pair, F.to_json(F.struct(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output")), keep))
                        .when(triple, F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")), keep))
                        .when(share, F.to_json(F.struct(F.transform("t", lambda x: F.struct(name(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")), keep))
                        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")), keep)).alias("record"))

"""Chat formatting with typed content parts.

A turn's content is a list of typed parts.  A visitor flattens them in order:
text is escaped, images, audio and documents become numbered placeholders, their
references are recorded and the tokens that they will expand to are counted
(text not among them).  A placeholder names its kind, turn and number there.

Each turn becomes one segment: <|turn|>role, line feed, body, <|end|>, line
feed.  Control strings inside texts and roles get a '~' after their first
character (one more if they have some already), which reading takes out again.
Segments of a conversation, in order, are its formatted text; nothing gathers a
conversation in memory, so one conversation may be any share of the table.

Cases.  Null texts are empty, null roles are ''.  Turns go by turn, then role,
then text, null turns first; repeated rows are turns of their own.  Null
conversation ids form one conversation.  Unknown kinds of part raise ValueError.
Columns other than conv_id, turn, role, text (or parts) are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings that this and other templates give a meaning.
CONTROL = re.compile(r"([<\[])(~*)(\||/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])~(~*)(\||/?s>|/?INST\])")
OPEN, END, ROLE_SCORED = "<|turn|>", "<|end|>", "assistant"
SEGMENTS = "conv_id long, turn long, role string, segment string, loss_start int, loss_end int, attachments array<struct<kind:string,index:int,ref:string,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1~\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits the parts of one turn."""

    #: What stands before a placeholder's number: the turn, so that numbers are told apart within a conversation.
    turn: str = ""
    out: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    attachments: list[dict] = field(default_factory=list)
    #: Tokens of an attachment: image patches of 28 x 28, 25 a second of audio, 600 a page.
    patch, per_second, per_page = 28, 25, 600

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:
            raise ValueError(f"unknown kind of part: {kind}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width") or 0, part.get("height") or 0
        self.attach("image", part, max(1, -(-w // self.patch) * -(-h // self.patch)))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, round((part.get("seconds") or 0) * self.per_second)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, (part.get("pages") or 0) * self.per_page))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        index = self.counts.get(kind, 0)
        self.counts[kind] = index + 1
        self.attachments.append({"kind": kind, "index": index, "ref": part.get("ref") or "", "tokens": tokens})
        self.out.append(f"<|{kind}:{self.turn}{index}|>")


def segment(role: str | None, parts: list[dict], turn: int | None = None) -> dict:
    flat = Flattener("" if turn is None else f"{turn}.")
    for p in parts:
        flat.visit(p)
    head, body = f"{OPEN}{escape_role(role or '')}\n", "".join(flat.out)
    scored = role == ROLE_SCORED
    return {"segment": f"{head}{body}{END}\n", "loss_start": len(head) if scored else None, "loss_end": len(head) + len(body) if scored else None, "attachments": flat.attachments, "expanded_tokens": sum(a["tokens"] for a in flat.attachments)}


def format_turns(turns: DataFrame) -> DataFrame:
    """One segment per row of conv_id, turn, role and text, or parts (an array of structs with type and what the kind needs)."""
    typed = "parts" in turns.columns
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("index", pa.int32()), ("ref", pa.string()), ("tokens", pa.int64())])), pa.int64()]
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, content = (batch.column(i).to_pylist() for i in range(4))
            made = [segment(r, (c or []) if typed else [{"type": "text", "text": c}], t) for r, c, t in zip(role, content, turn, strict=True)]
            columns = {"conv_id": conv, "turn": turn, "role": role} | {k: [m[k] for m in made] for k in names[3:]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in zip(names, kinds, strict=True)], names)

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "parts" if typed else "text").mapInArrow(run, SEGMENTS)


def parse(text: str) -> tuple[str, str]:
    """Role and text of a segment."""
    if not (text.startswith(OPEN) and text.endswith(f"{END}\n")):
        raise ValueError("not a segment")
    role, _, body = text[len(OPEN) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation, read from the segments alone, which stream through tasks in order: by turn, role and text, unescaped."""
    body = F.substring("segment", F.instr("segment", "\n") + 1, F.length("segment"))
    text = F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - len(END) - 1), ESCAPED.pattern, "$1$2$3")
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), text).select("conv_id", "segment", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        at, state = None, None
        close = lambda: (at, state["n"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"])
        for batch in batches:
            done = []
            for conv, text, a, z in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        done.append(close())
                    at, state = conv, {"n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                role, body = parse(text)
                state["all"].update(f"{role}\n{body}\n".encode())
                state["n"] += 1
                state["size"] += len(text)
                if a is not None:
                    scored = unescape(text[a:z])
                    state["loss"].update(scored.encode())
                    state["chars"] += len(scored)
            if done:
                yield pack(done)
        if state is not None:
            yield pack([close()])

    return ordered.mapInArrow(run, DIGESTS)


def control_conversation(spark: SparkSession) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))

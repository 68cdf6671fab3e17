"""Chat formatting: fingerprints of record layouts select declarative mappings to canonical turns; a reversible template."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<position:double,role:string,text:string>"
#: Scalars of a variant's schema: a fingerprint depends on field paths, not on a value's type or on nulls.
_SCALARS = r"\b(STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\(\d+, ?\d+\)|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|VARIANT)\b"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    `layout` is the normal form of its nested field paths (keys in the order of their code points, `_` for a scalar). Either
    `turns` lists (role, path) of single texts, or `each` is the path of a list of messages, with the paths of role and text in
    each. `key` and `order` are paths of a conversation's id and a turn's place where a record is only one turn. `roles`
    renames roles.
    """

    name: str
    layout: str
    turns: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = "$.role"
    text: str = "$.content"
    key: str | None = None
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn_rows", "OBJECT<conv_id: _, role: _, text: _, turn: _>", each="$", text="$.text", key="$.conv_id", order="$.turn"),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>", each="$.messages"),
    Mapping("conversations", "OBJECT<conversations: ARRAY<OBJECT<from: _, value: _>>>", each="$.conversations", role="$.from", text="$.value", roles=SPOKEN),
    Mapping("prompt_completion", "OBJECT<completion: _, prompt: _>", turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", "OBJECT<prompt: _, response: _>", turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question_answer", "OBJECT<answer: _, question: _>", turns=(("user", "$.question"), ("assistant", "$.answer"))),
    Mapping("instruction_output", "OBJECT<instruction: _, output: _>", turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input_output", "OBJECT<input: _, instruction: _, output: _>",
            turns=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("system_prompt_response", "OBJECT<prompt: _, response: _, system: _>",
            turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)


#: Scalar fields that say nothing about turns; records and messages may have them or not.
EXTRA = ("created_at", "id", "lang", "language", "model", "name", "source", "timestamp", "train", "weight")


def layout_of(record: Column, extra: tuple[str, ...] = EXTRA) -> Column:
    """Nested field paths of a variant in normal form, without the scalar fields `extra`."""
    paths = F.regexp_replace(F.schema_of_variant(record), _SCALARS, "_")
    if extra:
        paths = F.regexp_replace(paths, rf"(?<=[<,] ?)(?:{'|'.join(map(re.escape, extra))}): _(?:, |(?=>))", "")
        paths = F.regexp_replace(paths, ", >", ">")
    return paths


def fingerprint(layout: Column) -> Column:
    return F.xxhash64(layout)


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Append `mapping` (name), `conv_key` (variant, only of layouts by turn) and `turns` (array of position, role, text).

    The fingerprint of each row's layout selects its mapping. A layout without one (malformed, null or new) has null in all
    three, so that it can be counted and mapped; no row is dropped. Null texts and roles are empty. A column of such a
    name that is there already is replaced. The mappings are a short list, written into the plan.
    """
    rows = records.withColumn("_print", fingerprint(layout_of(F.col(record))))
    known = {m.name: F.col("_print") == F.xxhash64(F.lit(m.layout)) for m in mappings}
    rec = F.col(record)

    def said(source: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(source, path, "string"), F.lit(""))

    def role(source: Column, m: Mapping) -> Column:
        given, out = said(source, m.role), None
        for old, new in m.roles.items():
            out = (F.when if out is None else out.when)(given == old, F.lit(new))
        return given if out is None else out.otherwise(given)

    def turns(m: Mapping) -> Column:
        if m.turns:
            made = F.array(*[F.struct(F.lit(float(i)).alias("position"), F.lit(r).alias("role"), said(rec, p).alias("text")) for i, (r, p) in enumerate(m.turns)])
        elif m.order:
            place = F.try_variant_get(rec, m.order, "double")
            made = F.array(F.struct(place.alias("position"), role(rec, m).alias("role"), said(rec, m.text).alias("text")))
        else:
            items = F.try_variant_get(rec, m.each, "array<variant>")
            made = F.transform(items, lambda x, i: F.struct(i.cast("double").alias("position"), role(x, m).alias("role"), said(x, m.text).alias("text")))
        return made.cast(f"array<{TURN}>")

    name = key = found = None
    for m in mappings:
        name = (F.when if name is None else name.when)(known[m.name], F.lit(m.name))
        found = (F.when if found is None else found.when)(known[m.name], turns(m))
        if m.key:
            key = (F.when if key is None else key.when)(known[m.name], F.try_variant_get(rec, m.key, "variant"))
    key = F.lit(None).cast("variant") if key is None else key
    return rows.withColumn("mapping", name).withColumn("conv_key", key).withColumn("turns", found).drop("_print")


def by_conversation(turns: DataFrame, key: str, kind: str = "long", own: Column | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """`(key, turns)`, a row for each conversation, from what `canonical_turns` returned; any mixture of layouts.

    Records of layouts by turn are put together by their id: the turns of a conversation, ordered by position (null first), role and
    text; repeated turns stay; those without an id are one conversation whose id is null. Every other record is a conversation of its
    own under the id `own` (null if not given), with its turns in the order they have: none is lost or merged; a record without a
    mapping (an empty list of messages shows no layout either) has null for turns. Only records by turn are shuffled; one task holds a conversation.
    """
    by_turn = F.coalesce(F.col("mapping").isin([m.name for m in mappings if m.key]), F.lit(False))
    whole = turns.filter(~by_turn).select((F.lit(None) if own is None else own).cast(kind).alias(key), "turns")
    said = turns.filter(by_turn).select(F.try_variant_get("conv_key", "$", kind).alias(key), F.explode("turns").alias("turn"))
    return said.groupBy(key).agg(F.array_sort(F.collect_list("turn")).alias("turns")).unionByName(whole)


@dataclass(frozen=True)
class Template:
    """Marks around a conversation, a role and a text.

    Every mark begins with one of `opening` and none has `escape` as its second character; in roles and texts each of
    `opening` and `escape` is followed by `escape`. So no mark, and no control string that begins so, can come
    from a text, and the text can be read back.
    """

    begin: str = "<s>"
    role: str = "[ROLE]"
    text: str = "[/ROLE]\n"
    end: str = "</s>\n"
    opening: str = "<["
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.opening + self.escape)}])", lambda m: m[1] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.opening + self.escape)}]){re.escape(self.escape)}", lambda m: m[1], text)

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text, and the spans of code points under the loss mask."""
        out, spans, at = [self.begin], [], len(self.begin)
        for role, text in turns:
            head, body = f"{self.role}{self.escaped(role)}{self.text}", self.escaped(text)
            if role in self.trained:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(out), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        parts = formatted.removeprefix(self.begin).split(self.end)[:-1]
        cut = [p.removeprefix(self.role).split(self.text, 1) for p in parts]
        return [(self.unescaped(role), self.unescaped(text)) for role, text in cut]


def format_turns(conversations: DataFrame, key: str, template: Template | None = None) -> DataFrame:
    """`(key, formatted, mask)`: `mask` lists the spans (start, end; code points) of trained texts. Null turns have null for both."""
    template = template or Template()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [None if turns is None else template.format([(t["role"], t["text"]) for t in turns]) for turns in frame["turns"]]
            yield pd.DataFrame({
                key: frame[key], "formatted": pd.Series([d and d[0] for d in done], dtype=object),
                "mask": pd.Series([d and [{"start": a, "stop": b} for a, b in d[1]] for d in done], dtype=object),
            })

    kind = conversations.schema[key].dataType.simpleString()
    return conversations.select(key, "turns").mapInPandas(run, f"`{key}` {kind}, formatted string, mask array<struct<start:long,stop:long>>")


def read_back(formatted: DataFrame, key: str, template: Template | None = None) -> DataFrame:
    """What formatted texts and masks say: n_turns, turns_text (role, \\n, text, \\n per turn), loss_text, formatted_chars.

    A null text has no turns and null for the rest.
    """
    template = template or Template()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for x, mask in zip(frame["formatted"], frame["mask"], strict=True):
                if x is None:
                    rows.append((0, None, None, None, None))
                    continue
                turns = template.read(x)
                loss = "".join(template.unescaped(x[s["start"] : s["stop"]]) for s in mask)
                rows.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), loss, len(loss), len(x)))
            done = pd.DataFrame(rows, columns=["n_turns", "turns_text", "loss_text", "loss_chars", "formatted_chars"], dtype=object)
            done.insert(0, key, frame[key].to_numpy())
            yield done

    kind = formatted.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_turns long, turns_text string, loss_text string, loss_chars long, formatted_chars long"
    return formatted.mapInPandas(run, schema)

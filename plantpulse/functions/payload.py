"""Fields of JSON payloads held as VARIANT.

A payload is parsed once with ``try_parse_json``. The fields a contract looks at are then
read once each into a struct of text and type name (``fields_struct``), and all rules work
on that struct through ``Payload``. A field of an unexpected type costs only that field,
never the whole row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the decimal numbers accepted inside JSON strings.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Fixed value: the timestamps accepted, a date with an optional time and an optional offset.
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
# Fixed value: a time given to the minute, which a cast does not read.
WITHOUT_SECONDS = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-].*)?$"


# How a field is read: as text, as text and a time, a whole number or a number, or RAW: by type alone.
TEXT, TIME, WHOLE, NUMBER, RAW = "text", "time", "whole", "number", "raw"


@dataclass(frozen=True)
class Payload:
    """Column builders over a parsed message.

    ``raw`` is the text, ``body`` the VARIANT, ``fields`` holds value, type name and text of
    each field, ``typed`` its reading as time, whole number or number.
    """

    raw: str = "raw"
    body: str = "body"
    fields: str = "fields"
    typed: str = "typed"

    def _part(self, name: str, part: str) -> Column:
        return F.col(f"{self.fields}.{name}.{part}")

    def is_json(self) -> Column:
        return F.col(self.body).isNotNull()

    def is_object(self) -> Column:
        """For text known to be JSON: after JSON white space, an object starts with a brace."""
        return F.ltrim(F.col(self.raw), F.lit(" \t\n\r")).startswith("{")

    def value(self, name: str) -> Column:
        """Field as VARIANT."""
        return self._part(name, "value")

    def text(self, name: str) -> Column:
        """Field as text; NULL when absent or JSON null."""
        return self._part(name, "text")

    def kind(self, name: str) -> Column:
        """Type name of the field, for example BIGINT, STRING, VOID or OBJECT<...>; NULL when absent."""
        return self._part(name, "kind")

    def time(self, name: str) -> Column:
        """A TIME field as an instant; NULL when it is not an ISO timestamp."""
        return F.col(f"{self.typed}.{name}")

    def whole_number(self, name: str) -> Column:
        """A WHOLE field: fractions are cut, digits in text are read, booleans are 0 or 1."""
        return F.col(f"{self.typed}.{name}")

    def number(self, name: str) -> Column:
        """A NUMBER field: numbers, booleans and numbers in text; anything else is NULL."""
        return F.col(f"{self.typed}.{name}")

    def present(self, name: str) -> Column:
        return self.kind(name).isNotNull()

    def get(self, path: str, as_type: str) -> Column:
        return F.try_variant_get(F.col(self.body), f"$.{path}", as_type)

    def canonical(self, name: str | None = None) -> Column:
        """The whole payload or one field as compact JSON with sorted keys."""
        return F.to_json(F.col(self.body) if name is None else self.value(name))

    def display(self, name: str) -> Column:
        """Field as text where a boolean reads True or False, as union-typed fields are shown."""
        return F.when(self.kind(name) == "BOOLEAN", F.initcap(self.text(name))).otherwise(self.text(name))

    def is_number(self, name: str) -> Column:
        return is_number_kind(self.kind(name))

    def truthy(self, name: str) -> Column:
        """Field as a condition: empty text, zero, null, absent and empty containers are false."""
        kind, text = self.kind(name), self.text(name)
        return (
            F.when(kind == "BOOLEAN", text == "true")
            .when(self.is_number(name), self.value(name).try_cast("double") != 0.0)
            .when(kind == "STRING", text != "")
            .when(kind.startswith("OBJECT"), text != "{}")
            .when(kind.startswith("ARRAY"), text != "[]")
            .otherwise(F.lit(False))
        )


class FlatPayload(Payload):
    """A payload whose readings are columns of their own, named by ``prefix``. It notes what is asked of each field (``asked``),
    so that ``with_payloads`` reads that and no more."""

    def __init__(self, prefix: str):
        super().__init__()
        object.__setattr__(self, "prefix", prefix)
        object.__setattr__(self, "asked", {})

    def _part(self, name: str, part: str) -> Column:
        self.asked.setdefault(name, set()).add(part)
        return F.col(f"`{self.prefix}.{name}.{part}`")

    def time(self, name: str) -> Column:
        return self._part(name, "typed")

    whole_number = number = time

    def present(self, name: str) -> Column:
        return self._part(name, "present")


def is_number_kind(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def with_payload(messages: DataFrame, raw: Column, reads: dict[str, str], payload: Payload = Payload()) -> DataFrame:
    """Add the raw text, the parsed body and the fields to read.

    One cast of the body gives all fields at once. Each step is a projection of its own, so
    that what a later step uses several times is worked out once.
    """
    values = "_values"
    members = ", ".join(f"`{n}`: variant" for n in reads)
    parsed = messages.withColumn(payload.raw, raw)
    parsed = parsed.withColumn(payload.body, F.try_parse_json(payload.raw))
    parsed = parsed.withColumn(values, F.try_variant_get(F.col(payload.body), "$", f"struct<{members}>"))

    fields = []
    for n, reading in reads.items():
        parts = _parts(F.col(f"{values}.{n}"), reading)
        fields.append(F.struct(*[c.alias(part) for part, c in parts.items()]).alias(n))
    parsed = parsed.withColumn(payload.fields, F.struct(*fields)).drop(values)
    typed = [c.alias(n) for n, reading in reads.items() if (c := _typed(payload, n, reading)) is not None]
    return parsed.withColumn(payload.typed, F.struct(F.lit(True).alias("_"), *typed))


def with_payloads(messages: DataFrame, raw: Column, kinds: list[tuple[FlatPayload, Column, dict[str, str]]]) -> DataFrame:
    """Add the raw text, the parsed body and the readings of several kinds of message, each with its payload, the condition that
    a message is of this kind, and how its fields are read. A message is parsed once, and read for its own kind only.

    What the payloads were asked for before is read. A field of which only the text matters is cast to text at once: a VARIANT
    of its own and its type name cost more than the rest of a message.
    """
    first = kinds[0][0]
    some = kinds[0][1]
    for _, when, _ in kinds[1:]:
        some = some | when
    parsed = messages.withColumn(first.raw, raw)
    parsed = parsed.withColumn(first.body, F.when(some, F.try_parse_json(first.raw)))
    members, parts, typed = {}, [], {}
    for p, when, reads in kinds:
        values, types = f"_{p.prefix}", []
        for n, asked in p.asked.items():
            reading, wanted = reads[n], asked - {"typed"}
            if "typed" in asked:
                typed[f"{p.prefix}.{n}.typed"] = (p, n, reading)
                wanted |= {"text"} if reading == TIME else {"kind", "cast", "text"} if reading == NUMBER else {"kind", "cast"}
            value = F.col(f"{values}.{n}")
            if wanted <= {"text", "present"}:
                types.append(f"`{n}`: string")
                null = F.col(values).isNotNull() & F.try_variant_get(F.col(p.body), f"$.{n}", "variant").isNotNull()
                found = {"text": value, "present": value.isNotNull() | null}
            else:
                types.append(f"`{n}`: variant")
                found = {**_parts(value, reading), "present": value.isNotNull()}
            parts += [found[part].alias(f"{p.prefix}.{n}.{part}") for part in sorted(wanted)]
        members[values] = F.when(when, F.try_variant_get(F.col(p.body), "$", f"struct<{', '.join(types)}>"))
    carried = [c for c in messages.columns if c not in (first.raw, first.body)]
    parsed = parsed.withColumns(members).select(*carried, first.raw, first.body, *parts)
    return parsed.withColumns({name: _typed(*field) for name, field in typed.items()})


def _parts(value: Column, reading: str) -> dict[str, Column]:
    """A field's value, its type name, and its text and its cast where the reading asks for them."""
    parts = {"value": value, "kind": F.schema_of_variant(value)}
    if reading != RAW:
        parts["text"] = value.try_cast("string")
    if reading in (WHOLE, NUMBER):
        parts["cast"] = value.try_cast("bigint" if reading == WHOLE else "double")
    return parts


def _typed(payload: Payload, name: str, reading: str) -> Column | None:
    """A field read as time, whole number or number."""
    text, kind = payload.text(name), payload.kind(name)
    if reading == TIME:
        return timestamp(text)
    if reading == WHOLE:
        readable = is_number_kind(kind) | kind.isin("STRING", "BOOLEAN")
        return F.when(readable, payload._part(name, "cast"))
    if reading == NUMBER:
        cast = payload._part(name, "cast")
        readable = is_number_kind(kind) | (kind == "BOOLEAN") | ((kind == "STRING") & text.rlike(NUMBER_TEXT))
        return F.when((F.abs(cast) < F.lit(float("inf"))) & readable, cast)
    return None


def timestamp(raw: Column) -> Column:
    """ISO text to an instant in UTC; NULL when the text is not an ISO timestamp."""
    with_seconds = F.regexp_replace(raw, WITHOUT_SECONDS, "$1:00$2")
    return F.when(raw.rlike(ISO_TIMESTAMP), F.coalesce(raw.try_cast("timestamp"), with_seconds.try_cast("timestamp")))

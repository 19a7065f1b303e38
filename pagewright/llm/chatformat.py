"""Chat formatting by schema fingerprints (DataFrame functions only).

Records come as JSON of unlike layouts.  The nested field paths of a record
(``messages[].role``), sorted and hashed, are its schema fingerprint; it
selects a declarative mapping that says where turns, roles and texts stand, and
the record becomes canonical turns (role, text).  The template marks turns by
control strings; such strings inside texts are escaped by a backslash after
their first character, which is undone when the output is read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
# Control strings: a turn is [INST]role\ntext[/INST], an assistant's <s>role\ntext</s>.
ASK_OPEN, ASK_CLOSE, ANSWER_OPEN, ANSWER_CLOSE = "[INST]", "[/INST]", "<s>", "</s>"
_ESCAPE = r"([<\[])(\\*+)(/?s>|/?INST\])"
_UNESCAPE = r"([<\[])\\(\\*+)(/?s>|/?INST\])"
_CLOSE = r"\[/INST\]|</s>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: either one list of objects with a role
    and a text field, or one top-level field for each role."""
    name: str
    list_field: str = ""
    role_field: str = ""
    text_field: str = ""
    roles: dict = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()  # (role, field)

    def paths(self) -> list[str]:
        if self.list_field:
            return sorted(f"{self.list_field}[].{f}" for f in (self.role_field, self.text_field))
        return sorted(f for _, f in self.fields)


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("sharegpt", "conversations", "from", "value",
            roles={"human": "user", "gpt": "assistant", "system": "system"}),
    Mapping("dialog", "turns", "speaker", "text"),
    Mapping("completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON object, to one level of nesting;
    null if the record is no JSON object."""
    def below(key):
        # only a real list answers an index and only a real object a field
        place = F.concat(F.lit("$['"), key, F.lit("']"))
        in_list = F.json_object_keys(F.call_function("get_json_object", record, F.concat(place, F.lit("[0]"))))
        raw = F.call_function("get_json_object", record, place)
        in_object = F.when(raw.startswith("{"), F.filter(
            F.json_object_keys(raw),
            lambda k: F.call_function("get_json_object", record, F.concat(place, F.lit("['"), k, F.lit("']"))).isNotNull()))
        return F.when(F.size(in_list) > 0, F.transform(in_list, lambda k: F.concat(key, F.lit("[]."), k))) \
            .when(F.size(in_object) > 0, F.transform(in_object, lambda k: F.concat(key, F.lit("."), k))) \
            .otherwise(F.array(key))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.json_object_keys(record), below))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _by_mapping(mappings, prints: Column, value) -> Column:
    """CASE over the mappings' fingerprints."""
    out = None
    for m in mappings:
        test = prints == fingerprint(F.array(*[F.lit(p) for p in m.paths()]))
        out = F.when(test, value(m)) if out is None else out.when(test, value(m))
    return out


def canonical_turns(records: DataFrame, record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Adds ``schema_print``, ``layout`` and ``turns`` (array of role, text).

    A record of unknown layout, a null one and one that is no JSON object has
    null layout and turns.  A null role or text is empty.
    """
    fields = {}
    for m in mappings:
        if m.list_field:
            fields[m.list_field] = f"array<struct<`{m.role_field}`:string,`{m.text_field}`:string>>"
        for _, f in m.fields:
            fields[f] = "string"
    schema = "struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">"

    def turns(m: Mapping) -> Column:
        def turn(role, text):
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        if not m.list_field:
            return F.array(*[turn(F.lit(role), F.col(f"parsed.`{f}`")) for role, f in m.fields])

        def one(x):
            role = x[m.role_field]
            for old, new in m.roles.items():
                role = F.when(x[m.role_field] == old, new).otherwise(role)
            return turn(role, x[m.text_field])
        return F.transform(F.col(f"parsed.`{m.list_field}`"), one)

    known = records.withColumn("schema_print", fingerprint(field_paths(F.col(record_col))))
    known = known.withColumn("parsed", F.from_json(record_col, schema))
    return (known.withColumn("layout", _by_mapping(mappings, F.col("schema_print"), lambda m: F.lit(m.name)))
            .withColumn("turns", _by_mapping(mappings, F.col("schema_print"), turns)).drop("parsed"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def formatted(turns: Column) -> Column:
    """Canonical turns as one marked string."""
    def one(t):
        body = F.concat(F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]))
        return F.when(t["role"] == ASSISTANT, F.concat(F.lit(ANSWER_OPEN), body, F.lit(ANSWER_CLOSE))) \
            .otherwise(F.concat(F.lit(ASK_OPEN), body, F.lit(ASK_CLOSE)))
    return F.array_join(F.transform(turns, one), "")


def read_back(text: Column) -> Column:
    """Turns (role, text, loss) of a formatted string; the loss mask covers
    the texts between the answer marks."""
    def one(x):
        loss = x.startswith(ANSWER_OPEN)
        body = F.when(loss, F.substr(x, F.lit(len(ANSWER_OPEN) + 1))).otherwise(F.substr(x, F.lit(len(ASK_OPEN) + 1)))
        return F.struct(F.url_decode(F.substring_index(body, "\n", 1)).alias("role"),
                        unescape(F.substr(body, F.instr(body, "\n") + 1)).alias("text"), loss.alias("loss"))
    return F.transform(F.filter(F.split(text, _CLOSE), lambda x: x != ""), one)


def digests(df: DataFrame, id_col: str, formatted_col: str = "formatted") -> DataFrame:
    """Figures read back from the formatted output."""
    back = df.withColumn("back", read_back(F.col(formatted_col)))
    loss = F.filter("back", lambda t: t["loss"])
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(loss, lambda t: t["text"]), "")
    return (back.withColumn("masked", masked)
            .select(id_col, F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                    F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
                    F.length(formatted_col).cast("long").alias("formatted_chars"), "layout"))


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of a table of turns: each conversation becomes JSON in
    the layout that fits its roles.

    Turns are taken by turn number (null first), then role and text, so that
    ties and repeated rows have a defined order.  A conversation is one record
    and so stands in one row.
    """
    clean = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.col("t.role")
    text = lambda i: F.col("t")[i]["text"]
    human = F.transform("t", lambda x: F.struct(
        F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["text"].alias("value")))
    plain = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    pair, triple = F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    record = F.when(roles == pair, F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))) \
        .when(roles == triple, F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"),
                                                  text(2).alias("output")))) \
        .when(F.size(F.array_except(roles, pair)) == 0, F.to_json(F.struct(human.alias("conversations")))) \
        .otherwise(F.to_json(F.struct(plain.alias("messages"))))
    return turns.select("conv_id", record.alias("record"))


def format_records(records: DataFrame, record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Adds ``layout``, ``turns`` and ``formatted`` to JSON records."""
    return canonical_turns(records, record_col, mappings).withColumn("formatted", formatted(F.col("turns")))

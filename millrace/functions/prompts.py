"""Prompts, usage and scores inside posts, files and model answers.

Column expressions where the built-in functions can say it; the reader of PNG chunks is a small helper in Arrow batches."""

from __future__ import annotations

import html
import html.entities
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

LEAST_PROMPT = 40
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"

# The keys of PNG text chunks in order of preference, role tags of prompts, parts of the names of models that see, and score fields in order.
PNG_KEYS = ("workflow", "prompt", "parameters", "Parameters")
ROLE_TAGS = ("<role>", "<cognitive_framework>", "<instructions>")
VISION_HINTS = ("vl", "vision", "llava", "moondream", "bakllava", "minicpm-v", "qwen2-vl", "qwen2.5-vl", "internvl", "pixtral", "phi-3.5-vision", "phi-4-multimodal", "gemma-3", "granite-vision", "mlm-")
SCORE_FIELDS = ("OVR_Quality_Score", "REL_Quality_Score", "quality_score")


def balanced_braces(text: Column) -> Column:
    """The block from the first ``{`` to the brace that closes it; null without one.

    The text is cut behind every brace, so the walk goes from brace to brace: it carries the depth and the length so far."""
    tail = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(0).alias("end"))

    def step(a, piece):
        depth = a["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        length = a["length"] + F.length(piece)
        return F.struct(depth.alias("depth"), length.alias("length"), F.when((a["end"] == 0) & (depth == 0), length).otherwise(a["end"]).alias("end"))

    end = F.aggregate(F.split(tail, r"(?<=[{}])"), start, step, lambda a: a["end"])
    return F.nullif(F.substring(tail, F.lit(1), end), F.lit(""))


def prompt_of_post(text: Column) -> Column:
    """A brace block of over 50 characters, else a role-tag span, else what follows ``prompt:`` or ``prompt-``, else the whole text
    if it has over 40 characters; texts under 20 characters stay as they are, null is empty."""
    text = F.coalesce(text, F.lit(""))
    block = balanced_braces(text)
    tagged = F.regexp_extract(text, r"(?s)(<.*>)", 1)
    roles = F.lit(False)
    for tag in ROLE_TAGS:
        roles = roles | F.lower(text).contains(tag)
    after = F.regexp_extract(text, r"(?is)prompt\s*[:\-]\s*(.+)", 1)
    out = F.when(F.length(text) < 20, text).when(F.length(block) > 50, block).when(roles & (tagged != ""), tagged)
    return out.when(after != "", F.regexp_replace(after, r"^\s+|\s+$", "")).when(F.length(text) > LEAST_PROMPT, text).otherwise("")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def positive_text(graph: Column, titled_first: bool) -> Column:
    """The positive text of a node graph in JSON; null if it has none or isn't an object.

    Text nodes qualify unless their title says that they are negative.  With ``titled_first`` the last one whose title says positive
    goes before all others; else the first qualifies."""
    nodes = F.map_values(F.from_json(graph, "map<string,variant>"))
    read = lambda node, path, kind="string": F.try_variant_get(node, path, kind)
    text = lambda node: F.when(F.schema_of_variant(read(node, "$.inputs.text", "variant")) == "STRING", _stripped(read(node, "$.inputs.text")))
    sort = lambda title: F.when(title.contains("positive"), 1).when(title.contains("neg"), -1).otherwise(0)
    told = F.transform(F.filter(nodes, lambda n: read(n, "$.class_type") == "CLIPTextEncode"), lambda n: F.struct(text(n).alias("text"), sort(F.lower(F.coalesce(read(n, "$._meta.title"), F.lit("")))).alias("sort")))
    told = F.filter(told, lambda t: (t["sort"] >= 0) & (F.length(t["text"]) > 0))
    first = F.get(told, F.lit(0))["text"]
    return F.coalesce(F.try_element_at(F.filter(told, lambda t: t["sort"] == 1), F.lit(-1))["text"], first) if titled_first else first


@F.pandas_udf(MapType(StringType(), StringType()))
def png_texts(content: pd.Series) -> pd.Series:
    """Keyword and text of the uncompressed text chunks of a PNG, the last of a keyword; null for what is no PNG."""

    def chunks(data: bytes):
        rest = memoryview(data)[8:]
        while len(rest) >= 12:
            size = int.from_bytes(rest[:4], "big")
            yield bytes(rest[4:8]), bytes(rest[8 : 8 + size])
            rest = rest[12 + size :]

    def texts(data) -> dict[str, str] | None:
        if not data or bytes(data[:8]) != PNG_SIGNATURE:
            return None
        found = {}
        for kind, body in chunks(bytes(data)):
            if kind == b"IEND":
                break
            plain = re.fullmatch(rb"(?s)([^\0]*)\0(.*)", body) if kind == b"tEXt" else None
            wide = re.fullmatch(rb"(?s)([^\0]*)\0\0.[^\0]*\0[^\0]*\0(.*)", body) if kind == b"iTXt" else None
            for match, code in ((plain, "latin-1"), (wide, "utf-8")):
                if match:
                    found[match[1].decode("latin-1")] = match[2].decode(code, "replace")
        return found

    return content.map(texts)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    Spark's parser ends with the first value, whatever follows; inside both kinds of brackets nothing can."""
    inside = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"a":', "}"))]
    return inside[0] & inside[1] & F.try_parse_json(text).isNotNull()


def png_text_prompt(content: Column) -> Column:
    """The prompt in a PNG's text chunks, by PNG_KEYS: a node graph's positive text, or of a text that isn't JSON what stands before the negative
    prompt and the settings, if it has over 40 characters.

    Compressed chunks are skipped; anything that isn't a PNG gives null."""
    texts = png_texts(content)

    def of(key: str) -> Column:
        text = F.try_element_at(texts, F.lit(key))
        plain = _stripped(F.regexp_extract(text, r"(?s)\A(.*?)(?:Negative prompt:|Steps:|\z)", 1))
        return F.when(is_json(text), positive_text(text, False)).when(F.length(plain) > LEAST_PROMPT, plain)

    return F.coalesce(*map(of, PNG_KEYS))


def yaml_prompt(text: Column) -> Column:
    """The positive text of the node graph behind a quoted ``prompt:``; null without one."""
    graph = balanced_braces(F.regexp_extract(text, r"""(?s)["']prompt["']:(.*)""", 1))
    return positive_text(F.replace(graph, F.lit("\\'"), F.lit("'")), True)


def _references() -> tuple[Column, Column]:
    """What named references and the numbers of control characters and the like stand for, as literal maps."""
    special = [*range(160), *range(0xFDD0, 0xFDF0), *(plane << 16 | end for plane in range(17) for end in (0xFFFE, 0xFFFF))]
    maps = {name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")}, {str(n): html.unescape(f"&#{n};") for n in special}
    return tuple(F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in maps)


def closed_references(text: Column) -> Column:
    """Named and numeric character references that end in a semicolon decoded once, in order; others stay, such as those that a cut text ends with.

    The text is cut at the references, so that nothing decoded is looked at again."""
    named, special = _references()

    def char(reference: Column) -> Column:
        name = F.substring(reference, F.lit(2), F.length(reference) - 2)
        digits = F.regexp_replace(name, "^#[xX]?0*(?=.)", "")
        number = F.when(F.length(digits) > 7, 0x110000).when(F.lower(name).startswith("#x"), F.conv(digits, 16, 10).cast("int")).otherwise(F.conv(digits, 10, 10).cast("int"))
        return F.when(~name.startswith("#"), F.coalesce(F.try_element_at(named, name), reference)).otherwise(_code_point(number, special))

    pattern = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
    decoded = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), char)
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), decoded, lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def _code_point(number: Column, special: Column) -> Column:
    other = F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    return F.coalesce(F.try_element_at(special, number.cast("string")), other)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """All named and numeric character references decoded."""
    return text.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def message_text(message: Column) -> Column:
    """``content`` of a message struct, or ``reasoning_content`` where that is blank."""
    content = F.coalesce(message["content"], F.lit(""))
    return F.when(F.length(F.regexp_replace(content, r"\s+", "")) > 0, content).otherwise(F.coalesce(message["reasoning_content"], F.lit("")))


def _number(variant: Column, path: str, kinds: tuple[str, ...]) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.when(kind.isin(*kinds) | kind.startswith("DECIMAL"), F.try_variant_get(variant, path, "double"))


def usage_tokens(response: Column) -> Column:
    """(input, output) tokens in a response's JSON, from either naming of the fields; missing ones are 0."""
    v = F.try_parse_json(response)

    def tokens(*names: str) -> Column:
        counts = [F.nullif(F.try_variant_get(v, f"$.usage.{n}", "bigint"), F.lit(0)) for n in names]
        return F.coalesce(*counts, F.lit(0)).cast("long")

    return F.struct(tokens("prompt_tokens", "input_tokens").alias("input"), tokens("completion_tokens", "output_tokens").alias("output"))


def hub_score(record: Column) -> Column:
    """The first score field of an audit's JSON that is a number; truth values and texts aren't."""
    v = F.try_parse_json(record)
    return F.coalesce(*[_number(v, f"$.{name}", ("BIGINT", "DOUBLE", "FLOAT", "INT")) for name in SCORE_FIELDS])


def vision_capable(model: Column) -> Column:
    hints = "|".join(h.replace(".", r"\.") for h in VISION_HINTS)
    return F.coalesce(model.rlike(f"(?i)(?:{hints})"), F.lit(False))


def pick_vision_model(models: DataFrame, group: str) -> DataFrame:
    """``group, model``: the first model by ``position`` that looks capable of vision, else the first at all."""
    first = Window.partitionBy(group).orderBy(vision_capable(F.col("model")).desc(), "position")
    return models.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(group, "model")

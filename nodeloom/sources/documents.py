"""Documents in JSON or YAML: detection, strict reading, writing, and files as DataFrames."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.sources import json_text

try:
    import yaml
except ImportError:  # JSON documents work without it
    yaml = None

JSON, YAML = "json", "yaml"
MAX_CODE_POINTS = 256 << 20


class DocumentError(ValueError):
    pass


if yaml:

    class _Loader(yaml.SafeLoader):
        """YAML 1.2 core scalars: only true and false are booleans, decimals stay exact, names are unique strings."""

        yaml_implicit_resolvers: dict = {}

    for tag, pattern, first in (
        ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
        ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
        ("tag:yaml.org,2002:float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"),
        ("tag:yaml.org,2002:merge", r"^<<$", "<"),
    ):
        _Loader.add_implicit_resolver(tag, re.compile(pattern), [c if c != "\0" else "" for c in first])

    def _int(loader, node):
        text = node.value
        return int(text[2:], 8) if text.startswith("0o") else int(text[2:], 16) if text.startswith("0x") else int(text)

    def _map(loader, node):
        loader.flatten_mapping(node)
        out = {}
        for k, v in node.value:
            name = k.value if isinstance(k, yaml.ScalarNode) else None
            if name is None:
                raise DocumentError("member names must be scalars")
            if name in out:
                raise DocumentError(f"duplicate member name {name!r}")
            out[name] = loader.construct_object(v, deep=True)
        return out

    _Loader.add_constructor("tag:yaml.org,2002:int", _int)
    _Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: Decimal(node.value))
    _Loader.add_constructor("tag:yaml.org,2002:map", _map)


def parse_as(text: str, kind: str):
    """The value of a text in a given format; an empty document is an error."""
    text = text.removeprefix("﻿")
    if not text.strip():
        raise DocumentError("the document is empty")
    if kind == JSON:
        return json_text.parse(text)
    if yaml is None:
        raise DocumentError("YAML documents need PyYAML")
    if len(text) > MAX_CODE_POINTS:
        raise DocumentError("the document is too large")
    try:
        value = yaml.load(text, _Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise DocumentError(f"no YAML: {e}") from None
    if value is None and not re.search(r"(?m)^\s*(?:-{3}\s*)?(?:~|null)", text):
        raise DocumentError("the document is empty")
    return value


def parse(text: str):
    """JSON where the text starts like it and is it, else YAML."""
    start = text.removeprefix("﻿").lstrip()
    if start[:1] in ("{", "["):
        try:
            return parse_as(text, JSON)
        except json_text.InvalidJsonError as e:
            try:
                return parse_as(text, YAML)
            except DocumentError:
                raise e from None
    return parse_as(text, YAML)


if yaml:

    class _Dumper(yaml.SafeDumper):
        def ignore_aliases(self, data) -> bool:
            return True

    _NUMERIC = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|0[ox][0-9a-fA-F]+")

    def _string(dumper, text: str):
        return dumper.represent_scalar("tag:yaml.org,2002:str", text, style='"' if _NUMERIC.fullmatch(text) else "|" if "\n" in text else None)

    _Dumper.add_representer(str, _string)
    _Dumper.add_representer(Decimal, lambda d, v: d.represent_scalar("tag:yaml.org,2002:float", json_text.number_text(v)))


def write(value, kind: str = JSON) -> str:
    """JSON with two spaces a level, or YAML without a document mark; both end with a line break."""
    if kind == JSON:
        return json_text.write(value, indent=2) + "\n"
    if yaml is None:
        raise DocumentError("YAML documents need PyYAML")
    return yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 20)


def format_of(path: str) -> str:
    return JSON if path.lower().endswith(".json") else YAML


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text) of whole files, format by extension; parsed by the operators, in parallel."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.when(F.lower("path").endswith(".json"), JSON).otherwise(YAML)
    return files.select("path", kind.alias("format"), F.decode("content", F.lit("UTF-8")).alias("text"))

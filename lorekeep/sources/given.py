"""Texts and settings that are given rather than read from tables: standard input, and a TOML file found by a fixed order."""

from __future__ import annotations

import json
import os
import sys
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import checked_path

CONFIG_VARIABLE = "LOREKEEP_CONFIG"
CONFIG_PATHS = ("~/.config/lorekeep/config.toml", "~/.lorekeep/config.toml")


def given_text(text: str | None = None, read: Callable[[], str] = sys.stdin.read) -> str:
    """The text, or what `read` gives (standard input) where it is None; blank text raises."""
    text = read() if text is None else text
    if not text.strip():
        raise ValueError("no text given")
    return text


def given_row(spark: SparkSession, namespace: str, id_: str, text: str | None = None, metadata: str | None = None, read: Callable[[], str] = sys.stdin.read) -> DataFrame:
    """One row (namespace, id, text, metadata) to upsert; metadata must be a JSON object."""
    if metadata is not None and not isinstance(json.loads(metadata), dict):
        raise ValueError("metadata is no JSON object")
    return spark.createDataFrame([(namespace, id_, given_text(text, read), metadata or "{}")], "namespace string, id string, text string, metadata string")


def config(path: str | None = None, paths: tuple[str, ...] = CONFIG_PATHS) -> tuple[dict, str | None]:
    """(settings, where they are from): the file named, else that of LOREKEEP_CONFIG, else the first of `paths` that exists, else nothing.

    A file that is named but isn't there, or can't be read, raises.
    """
    named = path or os.environ.get(CONFIG_VARIABLE)
    found = os.path.expanduser(named) if named else next((p for p in map(os.path.expanduser, paths) if os.path.isfile(p)), None)
    if found is None:
        return {}, None
    with open(checked_path(found), "rb") as f:
        return tomllib.load(f), found

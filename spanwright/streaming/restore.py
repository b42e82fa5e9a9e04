"""Placeholders restored in streams of text pieces, however the pieces cut them.

Rows: session_id, channel, seq, kind ('map', 'delta', 'end'), delta, placeholder, surface. A channel is a field of one
choice, so that what is held back never mixes with another field's text. Map rows of a session come before
its deltas, in each channel that needs them; an end row releases what is held, so no tail is lost.
"""

from __future__ import annotations

import re
import typing

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

#: Longer than this nothing that is held back can become a placeholder.
MOST_HELD = 64
OUTPUT = "session_id long, channel string, seq long, text string"
_WHOLE = re.compile(r"<[A-Z][0-9A-Z_]*_\d+>")
_PREFIX = re.compile(r"<(?:[A-Z][A-Z0-9_]*)?(?:_\d?)?")


def may_grow(tail: str) -> bool:
    """Whether a tail from '<' on may still become a placeholder. A tag's own characters include digits and underscores."""
    return len(tail) < MOST_HELD and bool(_PREFIX.fullmatch(tail))


def release(buffer: str, surface_of) -> tuple[str, str]:
    """(what can go out, what is held back) of a buffer."""
    out, at = [], 0
    while at < len(buffer):
        lt = buffer.find("<", at)
        if lt < 0:
            out.append(buffer[at:])
            return "".join(out), ""
        out.append(buffer[at:lt])
        whole = _WHOLE.match(buffer, lt)
        if whole:
            out.append(surface_of(whole.group()))
            at = whole.end()
        elif may_grow(buffer[lt:]):
            return "".join(out), buffer[lt:]
        else:
            out.append("<")
            at = lt + 1
    return "".join(out), ""


_TEXT = StructType([StructField("text", StringType())])


class Restorer(StatefulProcessor):
    """Per (session, channel): the session's map and the characters held back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mapping = handle.getMapState("mapping", StructType([StructField("placeholder", StringType())]), StructType([StructField("surface", StringType())]))
        self.held = handle.getValueState("held", _TEXT)

    def _surface(self, placeholder: str) -> str:
        found = self.mapping.getValue((placeholder,)) if self.mapping.containsKey((placeholder,)) else None
        return placeholder if found is None else found[0]

    def handleInputRows(self, key, rows: typing.Iterator[pd.DataFrame], timer_values=None) -> typing.Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seq"], kind="stable")
        held = self.held.get()[0] if self.held.exists() else ""
        out = []
        for kind, seq, delta, placeholder, surface in zip(batch["kind"], batch["seq"], batch["delta"], batch["placeholder"], batch["surface"]):
            text = ""
            if kind == "map":
                self.mapping.updateValue((placeholder,), (surface,))
            elif kind == "delta":
                text, held = release(held + (delta or ""), self._surface)
            else:
                text, held = held, ""
            if text:
                out.append((key[0], key[1], seq, text))
        if held:
            self.held.update((held,))
        elif self.held.exists():
            self.held.clear()
        yield pd.DataFrame(out, columns=["session_id", "channel", "seq", "text"])

    def close(self) -> None:
        pass


def restore_stream(deltas: DataFrame) -> DataFrame:
    """session_id, channel, seq, text: each piece's text that can go out; empty ones don't. Needs the RocksDB state store."""
    return deltas.groupBy("session_id", "channel").transformWithStateInPandas(Restorer(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")

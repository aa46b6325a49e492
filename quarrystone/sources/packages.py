"""Zip packages written from columns: the counterpart of the package readers."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions import zips
from quarrystone.functions.arrow import arrow_function


def packed(parts: dict[str, Column], stored: bool = False, wide: bool = False) -> Column:
    """A zip (binary) with one entry for each of ``parts`` that is not null: name and text.  Names come from the plan; times are fixed.  ``wide``: its end is in the 64-bit format."""
    names = list(parts)

    @arrow_function("binary")
    def written(*columns: pd.Series) -> pd.Series:
        def one(texts):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as archive:
                for name, text in zip(names, texts, strict=True):
                    if text is not None:
                        archive.writestr(zipfile.ZipInfo(name), text)
            return _widened(out.getvalue()) if wide else out.getvalue()

        return pd.Series([one(texts) for texts in zip(*columns, strict=True)])

    return written(*parts.values())


def _widened(data: bytes) -> bytes:
    """``data`` with an end in the 64-bit format before its end record, which then points there."""
    *_, count, length, begin, _ = zips.END.unpack(data[-zips.END.size :])
    at = len(data) - zips.END.size
    end = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, length, begin)
    place = struct.pack("<4sIQI", b"PK\6\7", 0, at, 1)
    return data[:at] + end + place + zips.END.pack(zips.END_SIGN, 0, 0, zips.FULL_16, zips.FULL_16, zips.FULL_32, zips.FULL_32, 0)


def escaped(text: Column) -> Column:
    """``text`` as the content of an XML element."""
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text

"""MPEG audio frames, as far as telling a whole file, its length and silence needs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bit rates (kbit/s) and sample rates (Hz) of layer III by version, from the standard's tables.
RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def id3_length(data: bytes) -> int:
    """Bytes of an ID3v2 tag at the start: a header of ten and a size of four times seven bits."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    return 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])


def frame_length(data: bytes, at: int) -> int | None:
    """Bytes of the layer III frame that starts here, None for none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    rate, sample = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or rate in (0, 15) or sample == 3:
        return None
    kbit = RATES[1 if version == 3 else 2][rate]
    return (144 if version == 3 else 72) * kbit * 1000 // SAMPLES[version][sample] + (data[at + 2] >> 1 & 1)


def is_mp3(data: bytes | None) -> bool:
    """Whether a frame follows the tag, and where it ends another one does, or nothing."""
    if not data:
        return False
    start = id3_length(data)
    first = frame_length(data, start)
    if first is None:
        return False
    return start + first >= len(data) or frame_length(data, start + first) is not None


@F.pandas_udf(T.BooleanType())
def valid_mp3(content: pd.Series) -> pd.Series:
    return content.map(is_mp3)

"""Media probes over binary files: container, duration, whether the file is whole.  Read from the bytes alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = "container string, duration_s double, truncated boolean, reason string, size_bytes long"


def sniff(data: bytes, name: str = "") -> str:
    """By the first bytes, else by the name's ending."""
    if data[4:8] == b"ftyp":
        return "m4a"
    if data[:4] in (b"RIFF", b"RF64") and data[8:12] == b"WAVE":
        return "wav"
    if data[:3] == b"ID3" or len(data) > 1 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0:
        return "mp3"
    for start, kind in ((b"OggS", "ogg"), (b"fLaC", "flac"), (b"#!AMR", "amr"), (b"caff", "caf")):
        if data.startswith(start):
            return kind
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return end if end in ("m4a", "mp3", "mp4", "wav", "aac", "amr", "ogg", "opus", "flac", "wma", "3gp", "caf") else "unknown"


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int, bool]]:
    """Boxes of an MP4 region: kind, where its body begins and ends, and whether it reaches past the region."""
    while start + 8 <= end:
        size, kind, head = struct.unpack_from(">I", data, start)[0], data[start + 4 : start + 8], 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head:
            return
        yield kind, start + head, min(start + size, end), start + size > end
        start += size


def _clock(data: bytes, at: int, end: int) -> float:
    """Seconds of an mvhd or mdhd body."""
    if at + 20 > end:
        return 0.0
    scale, ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 and at + 32 <= end else struct.unpack_from(">II", data, at + 12)
    return ticks / scale if scale else 0.0


def probe_mp4(data: bytes) -> tuple[float | None, bool, str]:
    """A20."""
    top = {k: (a, b, over) for k, a, b, over in boxes(data, 0, len(data))}
    if b"moov" not in top:
        return None, True, "no moov box"
    if top[b"moov"][2]:
        return None, True, "moov box is cut"
    if b"mdat" not in top:
        return None, True, "no media data"
    if top[b"mdat"][2]:
        return None, True, "media data is cut"
    at, end, _ = top[b"moov"]
    inner = list(boxes(data, at, end))
    head = next(((a, b) for k, a, b, _ in inner if k == b"mvhd"), None)
    if head is None:
        return None, True, "no movie header"
    seconds = _clock(data, *head)
    for k, a, b, _ in inner:
        if k == b"trak" and not seconds:
            for k2, a2, b2, _ in boxes(data, a, b):
                if k2 == b"mdia":
                    seconds = max([seconds, *(_clock(data, a3, b3) for k3, a3, b3, _ in boxes(data, a2, b2) if k3 == b"mdhd")])
    if any(k == b"mvex" for k, *_ in inner):
        return None, False, "fragmented: duration unknown"
    bits = (top[b"mdat"][1] - top[b"mdat"][0]) * 8
    if seconds > 0 and bits / seconds < 1000:
        return seconds, True, "too few bytes for the duration"
    return seconds or None, False, ""


#: Fixed values of MPEG audio: bit rates (kbit/s) of layer III and sample rates by version.
RATES = {True: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0), False: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0)}
SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def frame(data: bytes, at: int) -> tuple[int, float] | None:
    """Bytes and seconds of the layer III frame at a place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    rate, sample = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or sample == 3 or rate in (0, 15):
        return None
    hz, one = SAMPLES[version][sample], version == 3
    n = 1152 if one else 576
    return n // 8 * RATES[one][rate] * 1000 // hz + (data[at + 2] >> 1 & 1), n / hz


def probe_mp3(data: bytes) -> tuple[float | None, bool, str]:
    """A21."""
    at = 10 + sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True)) if data[:3] == b"ID3" and len(data) > 10 else 0
    total, frames, declared = 0.0, 0, 0
    while at + 4 <= len(data):
        f = frame(data, at)
        if f is None:
            if data[at : at + 3] == b"TAG":
                break
            nxt = next((k for k in range(at + 1, min(at + 8192, len(data) - 3)) if frame(data, k)), None)
            if nxt is None:
                break
            at = nxt
            continue
        if not frames and (k := data[at : at + f[0]].find(b"Xing")) > 0 and data[at + k + 7] & 1:
            declared = struct.unpack_from(">I", data, at + k + 8)[0]
        if at + f[0] > len(data):
            return total or None, True, "last frame is cut"
        total, frames, at = total + f[1], frames + 1, at + f[0]
    if not frames:
        return None, True, "no audio frames"
    if declared and frames < 0.98 * declared:
        return total, True, "fewer frames than declared"
    if 0 < len(data) - at < 4 and data[at] == 0xFF:
        return total, True, "a frame header is cut"
    return total, False, ""


def probe_wav(data: bytes) -> tuple[float | None, bool, str]:
    """Lengths of 0 or all ones were never patched and read to the end."""
    open_ = (0, 0xFFFFFFFF)
    size = struct.unpack_from("<I", data, 4)[0] if len(data) >= 12 else 0
    at, rate, seconds = 12, 0, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt " and at + 24 <= len(data):
            rate = struct.unpack_from("<I", data, at + 16)[0]
        if kind == b"data":
            have = len(data) - at - 8
            if n not in open_ and n > have:
                return (have / rate if rate else None), True, "audio data is cut"
            seconds = (have if n in open_ else n) / rate if rate else None
            break
        at += 8 + n + n % 2
    else:
        return None, True, "no audio data"
    if size not in open_ and size + 8 > len(data) + 1:
        return seconds, True, "file is cut"
    return seconds, False, ""


def probe_bytes(data: bytes, name: str = "") -> dict:
    kind = sniff(data, name)
    seconds, cut, why = {"m4a": probe_mp4, "mp4": probe_mp4, "mp3": probe_mp3, "wav": probe_wav}.get(kind, lambda _: (None, not data, "" if data else "empty"))(data)
    return {"container": kind, "duration_s": seconds, "truncated": cut, "reason": why, "size_bytes": len(data)}


def probed(files: DataFrame) -> DataFrame:
    """Path and what its bytes say.  files: as read by the binaryFile source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [probe_bytes(bytes(b), p) for p, b in zip(df.path, df.content, strict=True)]
            yield pd.DataFrame(found, columns=[x.split()[0] for x in RESULT.split(", ")]).assign(path=df.path.to_numpy())[["path", *(x.split()[0] for x in RESULT.split(", "))]]

    return files.select("path", "content").mapInPandas(run, f"path string, {RESULT}")


def pieces(duration: float, most_s: float, overlap_s: float = 2.0) -> list[tuple[float, float]]:
    """K9: overlapping pieces that tile a duration."""
    n = max(1, -(-int(duration * 1000) // int(most_s * 1000)))
    step = duration / n
    return [(max(0.0, k * step - (overlap_s if k else 0)), duration if k == n - 1 else (k + 1) * step) for k in range(n)]


@F.udtf(returnType=T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
class SplitPieces:
    """K9 as a table function: split_pieces(duration, most_s)."""

    def eval(self, duration: float, most_s: float):  # noqa: ANN201
        for k, (a, b) in enumerate(pieces(duration, most_s)):
            yield k, a, b

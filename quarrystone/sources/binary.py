"""Binary and notation files: kinds by their first bytes, spreadsheets, music, formulas, strings, and PCM sound in windows.
Files come through Spark's binaryFile source; functions take bytes."""

from __future__ import annotations

import io
import re
import struct
import wave
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of files by kind.
MAGIC = (
    ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("25504446", "pdf"), ("504B0304", "zip"), ("1F8B", "gzip"),
    ("28B52FFD", "zstd"), ("4D546864", "midi"), ("494433", "mp3"), ("FFFB", "mp3"), ("4F676753", "ogg"), ("664C6143", "flac"), ("1A45DFA3", "webm"),
    ("50415231", "parquet"), ("53514C69746520666F726D6174203300", "sqlite"), ("7B", "json"), ("3C3F786D6C", "xml"),
)


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes, never its name; text if they are printable, else unknown."""
    h = F.hex(F.substring(content, 1, 16))
    body = F.hex(F.substring(content, 1, 64))
    out = F.when(h == "", "empty").when(body.rlike("^(?:(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E]|[89A-F][0-9A-F]))*$"), "text").otherwise("unknown")
    for sign, kind in reversed(MAGIC):
        out = F.when(h.startswith(sign), kind).otherwise(out)
    out = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav").otherwise(out)
    return F.when(F.substring(h, 9, 8) == "66747970", "mp4").otherwise(out)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", sniff(F.col("content")).alias("kind"), "content")


def xlsx(content: bytes) -> list[tuple[str, int, str, str]]:
    """(sheet, row, column, value) of filled cells."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")]
        out = []
        for i, title in enumerate(titles, 1):
            f = f"xl/worksheets/sheet{i}.xml"
            if f not in names:
                continue
            for c in ET.fromstring(z.read(f)).iter(f"{{{ns['m']}}}c"):
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else (v.text or "") if v is not None else ""
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                if text:
                    col, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    out.append((title, int(row), col, text))
    return out


def varlen(b: bytes, i: int) -> tuple[int, int]:
    n = 0
    while True:
        n = n << 7 | b[i] & 0x7F
        i += 1
        if not b[i - 1] & 0x80:
            return n, i


def midi(content: bytes) -> list[tuple[int, int, int, int]]:
    """(track, tick, channel, note) of notes that begin."""
    out, i, track = [], 14, 0
    while i + 8 <= len(content):
        kind, size = content[i : i + 4], struct.unpack(">I", content[i + 4 : i + 8])[0]
        i += 8
        end = i + size
        if kind == b"MTrk":
            tick = status = 0
            while i < end:
                d, i = varlen(content, i)
                tick += d
                if content[i] & 0x80:
                    status = content[i]
                    i += 1
                if status == 0xFF:
                    n, j = varlen(content, i + 1)
                    i = j + n
                elif status in (0xF0, 0xF7):
                    n, j = varlen(content, i)
                    i = j + n
                else:
                    if status & 0xF0 == 0x90 and content[i + 1]:
                        out.append((track, tick, status & 0x0F, content[i]))
                    i += 1 if status & 0xF0 in (0xC0, 0xD0) else 2
            track += 1
        i = end
    return out


def musicxml(content: bytes) -> list[tuple[str, int, str]]:
    """(part, measure, pitch) of sounding notes."""
    out = []
    for p in ET.fromstring(content).iter("part"):
        for m in p.iter("measure"):
            for n in m.iter("note"):
                if (x := n.find("pitch")) is not None:
                    alter = int(float(x.findtext("alter") or 0))
                    out.append((p.get("id") or "", int(re.sub(r"\D", "", m.get("number") or "0") or 0), f"{x.findtext('step')}{'#' * alter if alter > 0 else 'b' * -alter}{x.findtext('octave')}"))
    return out


def abc(text: str) -> dict[str, str | int]:
    """title, metre, key and the number of notes of an ABC tune."""
    head = dict(re.findall(r"(?m)^([TMK]):\s*(.+)$", text))
    body = re.sub(r'"[^"]*"|%.*', "", re.sub(r"(?m)^[A-Za-z]:.*$", "", text))
    return {"title": head.get("T", ""), "metre": head.get("M", ""), "key": head.get("K", ""), "notes": len(re.findall(r"[A-Ga-g]", body))}


def tex_text(text: str) -> str:
    """TeX without commands, comments and mathematics."""
    t = re.sub(r"(?<!\\)%.*", "", text)
    t = re.sub(r"\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\begin\{(equation|align|displaymath)\*?\}.*?\\end\{\1\*?\}", " ", t, flags=re.S)
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?|\\(?:label|ref|cite\w*|includegraphics|usepackage|documentclass)(?:\[[^\]]*\])?\{[^}]*\}", " ", t)
    t = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?|[{}~]", " ", t)
    return re.sub(r"\s+", " ", t).strip()


def mathml_text(content: bytes | str) -> str:
    """A formula's tokens in reading order."""
    return " ".join((e.text or "").strip() for e in ET.fromstring(content).iter() if (e.text or "").strip())


def strings(content: bytes, least: int = 4) -> list[str]:
    """Printable runs."""
    return [m.decode("ascii") for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, content)]


def pcm_windows(content: bytes, seconds: float = 30.0, rate: int = 16_000) -> list[tuple[int, float, int, float, float]]:
    """(window, start, samples, peak, rms) of a WAV file as one channel at 16 kHz, in windows of fixed length: memory holds one
    window, whatever the file's."""
    out = []
    with wave.open(io.BytesIO(content)) as w:
        ch, width, fr = w.getnchannels(), w.getsampwidth(), w.getframerate()
        i = 0
        while raw := w.readframes(int(fr * seconds)):
            x = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(np.float32)
            x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
            x = x.reshape(-1, ch).mean(1)
            n = max(1, round(len(x) * rate / fr))
            y = np.interp(np.arange(n) * fr / rate, np.arange(len(x)), x)
            out.append((i, i * seconds, n, float(np.abs(y).max()), float(np.sqrt((y * y).mean()))))
            i += 1
    return out


def over_files(df: DataFrame, read: Callable, columns: str) -> DataFrame:
    """(path, columns) of files (path, content); a file that can't be read gives a row in ``gap`` instead of failing the job."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for p, b in zip(f["path"], f["content"]):
                try:
                    rows += [(p, *x, None) for x in read(bytes(b))]
                except Exception as e:  # noqa: BLE001 - any broken file is a gap, with its reason
                    rows.append((p, *[None] * len(names), f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", *names, "gap"])

    return df.select("path", "content").mapInPandas(run, f"path string, {columns}, gap string")

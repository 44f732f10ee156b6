"""Content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.fixed_values import QUICK_HASH_SAMPLE


def quick_hash(content: Column, size: Column, sample: int = QUICK_HASH_SAMPLE) -> Column:
    """SHA-256 over the size as text, the first sample and, past one sample, the last."""
    head = F.substring(content, F.lit(1), F.lit(sample))
    tail = F.substring(content, F.greatest(size - sample, F.lit(0)).cast("int") + 1, F.lit(sample))
    parts = F.when(size > sample, F.concat(F.encode(size.cast("string"), "UTF-8"), head, tail)) \
             .otherwise(F.concat(F.encode(size.cast("string"), "UTF-8"), head))
    return F.upper(F.sha2(parts, 256))


def package_hash(marker_content: Column) -> Column:
    """Quick hash of a folder package: its marker file stands for the whole."""
    return F.concat(F.lit("paramsfo:"), sha256_hex(marker_content))


def sha256_hex(content: Column) -> Column:
    return F.upper(F.sha2(content, 256))


def sha1_hex(content: Column) -> Column:
    return F.upper(F.sha1(content))


def crc32_hex(content: Column) -> Column:
    return F.lpad(F.hex(F.crc32(content)), 8, "0")


def payload(content: Column, skip: Column) -> Column:
    """Content without its first ``skip`` bytes."""
    return F.substring(content, skip.cast("int") + 1, F.length(content))


def header_skip(system_key: Column, extension: Column, size: Column) -> Column:
    """Length of a copier header, 0 for none."""
    key, ext = F.upper(system_key), F.lower(extension)
    return (F.when((key == "NES") & (ext == ".nes") & (size > 16) & ((size - 16) % 8192 == 0), 16)
            .when((key == "FDS") & (ext == ".fds") & (size > 16) & ((size - 16) % 65500 == 0), 16)
            .when((key == "SNES") & (size > 512) & (size % 1024 == 512), 512)
            .otherwise(0))

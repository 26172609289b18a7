"""Scalar rules of the model as column expressions: identifiers, names, times, modes, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPO_KEY = "palimpsest"
INLINE_MAX = 4096
BLOCK = 65536
#: Fixed values of the format: object types by number, commit kinds by number.
OBJECT_TYPES = {"chunk": 1, "chunk_page": 2, "chunk_list": 3, "legacy_tree": 4, "commit": 5, "log_segment": 6, "tree": 7}
COMMIT_KINDS = {"auto": 1, "manual": 2, "merge": 3, "restore": 4, "reset": 5, "import": 6}


def object_id(kind: str, payload: Column, key: str = REPO_KEY) -> Column:
    """Identity of an object: equal type and payload in one repository, equal id."""
    return F.sha2(F.concat(F.lit(key + chr(OBJECT_TYPES[kind])), payload), 256)


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 12)


def content_class(size: Column, chunks: Column) -> Column:
    """inline up to INLINE_MAX bytes, else chunk for one chunk, else chunk_list."""
    return F.when(size <= INLINE_MAX, "inline").when(chunks == 1, "chunk").otherwise("chunk_list")


def file_id(path: Column) -> Column:
    """A stable id in [2**32, 2**63) for a path that has none yet."""
    return F.pmod(F.xxhash64(path), F.lit((1 << 63) - (1 << 32))) + F.lit(1 << 32)


def synthetic_id(parent: Column, name: Column) -> Column:
    """An unsigned number of 64 bits, the highest set, in decimal digits: for entries without a file id."""
    h = F.substring(F.sha2(F.concat(parent.cast("string"), F.lit("/"), name), 256), 1, 16)
    return F.conv(F.concat(F.translate(F.substring(h, 1, 1), "01234567", "89abcdef"), F.substring(h, 2, 15)), 16, 10)


def parent(path: Column) -> Column:
    """Directory of a path; the root's and a top entry's is the empty path."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """The root, all directories above, and the path itself."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def clean_path(path: Column) -> Column:
    """Without empty segments."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def valid_branch(c: Column) -> Column:
    """1 to 100 of A-Z a-z 0-9 . _ -, not starting with . or -, without .., not eight or more hex digits alone."""
    return c.rlike(r"^[A-Za-z0-9._-]{1,100}\z") & ~c.rlike(r"^[.-]") & ~c.contains("..") & ~c.rlike(r"^[0-9A-Fa-f]{8,}\z")


def valid_entry_name(c: Column) -> Column:
    return (c != "") & ~c.isin(".", "..") & ~c.contains("/") & ~c.contains("\u0000")


def parse_refspec(c: Column) -> Column:
    """struct(kind, target, path): snap/<name>, a commit prefix of 8 to 64 small hex digits, or a branch; then :path.

    Null if it is none of these, or if the path begins with a slash; a trailing slash goes, and an empty path is none.
    """
    target = F.regexp_extract(c, r"(?s)^([^:]*)", 1)
    raw = F.when(c.contains(":"), F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1))
    path = F.regexp_replace(raw, "/+$", "")
    snap = F.substring(target, 6, 1000)
    kind = F.when(target.startswith("snap/") & valid_branch(snap), "snapshot").when(target.rlike(r"^[0-9a-f]{8,64}\z"), "commit").when(valid_branch(target), "branch")
    ok = kind.isNotNull() & ~F.coalesce(raw.startswith("/"), F.lit(False))
    return F.when(ok, F.struct(kind.alias("kind"), F.when(kind == "snapshot", snap).otherwise(target).alias("target"), F.when(path != "", path).alias("path")))


def tombstone_name(key: Column) -> Column:
    """Before the last dot, if digits follow it."""
    return F.when(key.rlike(r"(?s)^.*\.[0-9]+\z"), F.regexp_extract(key, r"(?s)^(.*)\.[0-9]+\z", 1))


def tombstone_secs(key: Column) -> Column:
    return F.when(key.rlike(r"(?s)^.*\.[0-9]+\z"), F.try_to_number(F.regexp_extract(key, r"\.([0-9]+)\z", 1), F.lit("999999999999999999")).cast("long"))


def rfc3339(ns: Column) -> Column:
    """UTC in whole seconds, rounded down."""
    return F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(c: Column) -> Column:
    """Nanoseconds of exactly yyyy-mm-ddThh:mm:ssZ; null for anything else."""
    form = c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z")
    return F.when(form, F.unix_seconds(F.try_to_timestamp(F.regexp_replace(c, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss "))) * 1_000_000_000)


def mode_string(kind: Column, mode: Column) -> Column:
    """As ls -l shows it."""
    bits = [F.when(F.getbit(mode, F.lit(8 - i)) == 1, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(F.when(kind == "dir", "d").when(kind == "symlink", "l").otherwise("-"), *bits)


def listing_line(kind: Column, mode: Column, size: Column, shown: Column, target: Column) -> Column:
    """Mode, size and name; a directory's name ends with a slash, a symlink's is followed by its target."""
    tail = F.when(kind == "dir", F.concat(shown, F.lit("/"))).when(kind == "symlink", F.concat(shown, F.lit(" -> "), target)).otherwise(shown)
    return F.concat_ws(" ", mode_string(kind, mode), F.lpad(size.cast("string"), 10, " "), tail)


def human_bytes(n: Column) -> Column:
    """Bytes up to 1023, else with one decimal in the largest unit that leaves at least 1."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        tenths = F.floor(n * 10 / F.lit(1 << (10 * i)) + 0.5)
        out = F.when(n >= 1 << (10 * i), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_size(c: Column) -> Column:
    """Bytes of a number with an optional K, M, G or T (powers of 1024); null otherwise."""
    digits, unit = F.regexp_extract(c, r"^(\d{1,12})([KMGT]?)\z", 1), F.regexp_extract(c, r"^(\d{1,12})([KMGT]?)\z", 2)
    times = F.when(unit == "", 1).when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1 << 40)
    return F.when(digits != "", F.when(digits == "", F.lit(None)).otherwise(digits).cast("long") * times)


def duration(seconds: Column) -> Column:
    """In the largest whole unit."""
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))


def auto_fork(branch: Column, host: Column, n: Column) -> Column:
    """The branch that a lost race is published to: <branch>.<host>, from the second try on with -<n>."""
    clean = F.regexp_replace(F.lower(host), "[^a-z0-9-]", "-")
    return F.concat(branch, F.lit("."), clean, F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))


def both_name(file: Column, source: Column, n: Column) -> Column:
    """The name of the other side's copy: <stem>.<source>.<ext>, split at the last dot unless it is first; -<n> from 2 on."""
    dotted = file.rlike(r"(?s)^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_extract(file, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(file)
    ext = F.when(dotted, F.regexp_extract(file, r"(?s)^.+(\.[^.]*)$", 1)).otherwise("")
    return F.concat(stem, F.lit("."), source, F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), ext)


def _block_of(at: Column) -> Column:
    """The block of a byte; 64 for all beyond, as numbers of blocks past 2^31 are no int."""
    return F.greatest(F.lit(0), F.least(F.lit(64), F.floor(at / BLOCK))).cast("int")


def blocks_of(start: Column, end: Column) -> Column:
    """Bitmap of the 64 KiB blocks that [start, end) touches, up to 64 of them; 0 if it is empty."""
    first, last = _block_of(start), _block_of(end - 1)
    # Ones shifted in from either side: no step subtracts, as 1 << 63 less 1 is beyond a long.
    up_to = F.when(last >= 63, F.lit(-1).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - last))
    since = F.when(first >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), first))
    return F.when((end > start) & (end > 0), up_to.bitwiseAND(since)).otherwise(F.lit(0).cast("long"))


def present_bytes(blocks: Column, length: Column) -> Column:
    """Bytes of the blocks in the bitmap; the last block may be short, if it is one of the 64."""
    last = _block_of(length - 1)
    short = F.when((length > 0) & (length % BLOCK != 0) & (last <= 63) & (F.call_function("shiftright", blocks, last).bitwiseAND(F.lit(1).cast("long")) == 1), BLOCK - length % BLOCK).otherwise(0)
    return F.bit_count(blocks) * BLOCK - short

"""Files and archive members by byte ranges, on a mounted path or in a store that pyarrow reaches; what is read is counted."""

from __future__ import annotations

import os
import struct
import zlib
from fnmatch import fnmatch
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


class RangedFile:
    """Bytes of a file at an offset."""

    def __init__(self, uri: str):
        self.read_bytes, path = 0, local_path(uri)
        if path is not None:
            self._f = open(path, "rb")
            self.size = os.fstat(self._f.fileno()).st_size
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self._f = store.open_input_file(path)
            self.size = self._f.size()

    def at(self, offset: int, n: int) -> bytes:
        self._f.seek(offset)
        out = self._f.read(n)
        self.read_bytes += len(out)
        if len(out) != n:
            raise ValueError(f"the file ends {n - len(out)} bytes early")
        return bytes(out)

    def close(self) -> None:
        self._f.close()


class Member:
    """A stored member: ranges of the archive. A deflated one: inflated from its start as far as asked, forwards; going back starts anew, so ask in order."""

    STEP = 1 << 18

    def __init__(self, archive: RangedFile, name: str, method: int, offset: int, packed: int, size: int):
        if method not in (0, 8):
            raise ValueError(f"{name}: compression method {method} isn't read")
        self.archive, self.name, self.method, self.size, self._packed = archive, name, method, size, packed
        head = archive.at(offset, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{name}: no member starts at {offset}")
        self._start = offset + 30 + sum(struct.unpack("<HH", head[26:30]))
        self._rewind()

    def _rewind(self) -> None:
        self._inflate, self._read, self._held, self._from = zlib.decompressobj(-15), 0, bytearray(), 0

    def at(self, offset: int, n: int) -> bytes:
        if offset + n > self.size:
            raise ValueError(f"{self.name} ends {offset + n - self.size} bytes early")
        if self.method == 0:
            return self.archive.at(self._start + offset, n)
        if offset < self._from:
            self._rewind()
        while self._from + len(self._held) < offset + n:
            step = min(self.STEP, self._packed - self._read)
            if not step and not self._inflate.unconsumed_tail:
                raise ValueError(f"{self.name} ends early")
            piece = self._inflate.unconsumed_tail + (self.archive.at(self._start + self._read, step) if not self._inflate.unconsumed_tail else b"")
            self._read += 0 if self._inflate.unconsumed_tail else step
            self._held += self._inflate.decompress(piece, 4 * self.STEP)
            if (drop := min(len(self._held), offset - self._from)) > 0:  # nothing before the offset is kept
                del self._held[:drop]
                self._from += drop
        lo = offset - self._from
        return bytes(self._held[lo : lo + n])

    def close(self) -> None:
        self.archive.close()


def directory(archive: RangedFile) -> list[tuple[str, int, int, int, int]]:
    """(name, method, offset, packed, size) of each member, from the central directory at the archive's end."""
    tail = archive.at(max(0, archive.size - 65_557), min(archive.size, 65_557))
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no central directory: not a ZIP archive")
    n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if (n == 0xFFFF or start == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        record = archive.at(struct.unpack("<Q", tail[at - 12 : at - 4])[0], 56)
        n, length, start = struct.unpack("<QQQ", record[32:56])
    rows, out, p = archive.at(start, length), [], 0
    for _ in range(n):
        if rows[p : p + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, packed, size, a, b, c, offset = struct.unpack("<10xH8xIIHHH8xI", rows[p : p + 46])
        name, extra = rows[p + 46 : p + 46 + a].decode("utf-8", "replace"), rows[p + 46 + a : p + 46 + a + b]
        while len(extra) >= 4:  # sizes of 64 bits stand there, those that don't fit, in this order
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                size, packed, offset = (next(wide) if v == 0xFFFFFFFF else v for v in (size, packed, offset))
            extra = extra[4 + k :]
        if not name.endswith("/"):
            out.append((name, method, offset, packed, size))
        p += 46 + a + b + c
    return out


def members(path: str) -> list[tuple[str, str]]:
    """(path, member) of each file that ``path`` names: a file itself, or archive.zip!pattern."""
    archive, _, pattern = path.partition("!")
    if not pattern:
        return [(path, "")]
    f = RangedFile(archive)
    try:
        return [(archive, x[0]) for x in sorted(directory(f)) if fnmatch(x[0], pattern)]
    finally:
        f.close()


def opened(path: str, member: str = "") -> RangedFile | Member:
    f = RangedFile(path)
    if not member:
        return f
    found = [x for x in directory(f) if x[0] == member]
    if not found:
        raise FileNotFoundError(f"{member} is not in {path}")
    return Member(f, *found[0])

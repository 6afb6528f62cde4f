"""Working copies of git repositories as a data source: ``spark.read.format("git_repositories").option("roots", ...)``.

Files are read as they lie: references, configuration, the index, loose and packed objects; no command is run. The option
``table`` is ``checkouts`` (one row a root) or ``worktree`` (one row a tracked path); ``roots`` has one path a line.
Each root's paths are dealt to ``parts`` tasks.

Defined results: a folder that is in no repository gives no row. A repository without commits has a null head, no roots
and no lineage. A path is dirty if its file isn't the index's blob, or that isn't the head's; a deleted file has a null
hash; content filters (line ends) aren't applied, and untracked files aren't told. A shallow history ends where it was
cut. ``state_hash`` is a digest of the dirty paths and what is in them; a clean copy's is that of none.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHECKOUTS = "root string, repository string, lineage string, head string, branch string, subject string, roots array<string>, remotes array<string>, state_hash string"
WORKTREE = "root string, path string, content_hash string, dirty boolean, status string"
# The kinds of packed objects, by number.
_KINDS = {1: b"commit", 2: b"tree", 3: b"blob", 4: b"tag"}
_OFFSET_DELTA, _NAME_DELTA = 6, 7
_LINK, _MODULE = 0o120000, 0o160000


def digest(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _file(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except (FileNotFoundError, NotADirectoryError, IsADirectoryError):
        return None


def patched(base: bytes, delta: bytes) -> bytes:
    """``base`` after a delta's copies and insertions."""
    at = 0

    def size() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = delta[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    size()
    whole, out = size(), bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op < 128:
            out += delta[at : at + op]
            at += op
            continue
        given = []
        for bit in range(7):
            given.append(delta[at] if op >> bit & 1 else 0)
            at += op >> bit & 1
        offset, count = int.from_bytes(bytes(given[:4]), "little"), int.from_bytes(bytes(given[4:]), "little") or 0x10000
        out += base[offset : offset + count]
    if len(out) != whole:
        raise ValueError("a delta doesn't fit its base")
    return bytes(out)


class Pack:
    """A pack and its index: names in order, and where each object begins."""

    def __init__(self, path: str):
        index = _file(path) or b""
        if index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{path}: not an index of version 2")
        self.path, self.data = path.removesuffix(".idx") + ".pack", None
        n = struct.unpack(">I", index[8 + 255 * 4 : 8 + 256 * 4])[0]
        names = 8 + 1024
        self.names = [index[names + 20 * k : names + 20 * k + 20] for k in range(n)]
        small = struct.unpack(f">{n}I", index[names + 24 * n : names + 28 * n])
        far = names + 28 * n
        self.offsets = [x if x < 1 << 31 else struct.unpack(">Q", index[far + 8 * (x & 0x7FFFFFFF) : far + 8 * (x & 0x7FFFFFFF) + 8])[0] for x in small]

    def find(self, name: bytes) -> int | None:
        k = bisect.bisect_left(self.names, name)
        return self.offsets[k] if k < len(self.names) and self.names[k] == name else None

    def read(self, offset: int, objects: Objects) -> tuple[bytes, bytes]:
        """Kind and content; a chain of deltas is followed to its base and applied from there."""
        if self.data is None:
            self.data = open(self.path, "rb")  # noqa: SIM115  open as long as the reader is
        deltas: list[bytes] = []
        while True:
            self.data.seek(offset)
            head = self.data.read(64)
            kind, at = head[0] >> 4 & 7, 1
            while head[at - 1] & 128:
                at += 1
            base, back = offset, 0
            if kind == _OFFSET_DELTA:
                back = head[at] & 127
                while head[at] & 128:
                    at += 1
                    back = (back + 1 << 7) | (head[at] & 127)
                at += 1
            name = head[at : at + 20] if kind == _NAME_DELTA else b""
            at += len(name)
            self.data.seek(offset + at)
            inflate, body = zlib.decompressobj(), bytearray()
            while not inflate.eof:
                body += inflate.decompress(self.data.read(1 << 16))
            if kind in _KINDS:
                found = bytes(body)
                break
            deltas.append(bytes(body))
            if kind == _NAME_DELTA:
                whole, found = objects.read(name)
                kind = next(k for k, v in _KINDS.items() if v == whole)
                break
            offset = base - back
        for delta in reversed(deltas):
            found = patched(found, delta)
        return _KINDS[kind], found


class Objects:
    """A repository's objects, loose, packed, or in a repository that it borrows from."""

    def __init__(self, path: str):
        self.folders, todo = [], [path]
        while todo:
            folder = todo.pop()
            if folder not in self.folders:
                self.folders.append(folder)
                lines = (_file(f"{folder}/info/alternates") or b"").decode().splitlines()
                todo += [os.path.normpath(os.path.join(folder, x)) for x in lines if x and not x.startswith("#")]
        self.packs: list[Pack] | None = None

    def read(self, name: bytes) -> tuple[bytes, bytes]:
        text = name.hex()
        for folder in self.folders:
            if raw := _file(f"{folder}/{text[:2]}/{text[2:]}"):
                head, _, body = zlib.decompress(raw).partition(b"\0")
                return head.split(b" ")[0], body
        if self.packs is None:
            self.packs = [Pack(f"{f}/pack/{x}") for f in self.folders if os.path.isdir(f"{f}/pack") for x in sorted(os.listdir(f"{f}/pack")) if x.endswith(".idx")]
        for pack in self.packs:
            if (offset := pack.find(name)) is not None:
                return pack.read(offset, self)
        raise KeyError(text)


class Repository:
    """One working copy."""

    def __init__(self, root: str, folder: str):
        self.root, self.folder = root, folder
        common = (_file(f"{folder}/commondir") or b".").decode().strip()
        self.common = os.path.normpath(os.path.join(folder, common))
        self.objects = Objects(f"{self.common}/objects")

    @classmethod
    def around(cls, path: str) -> Repository | None:
        """The working copy that ``path`` is in."""
        at = os.path.realpath(path)
        while True:
            here = f"{at.rstrip('/')}/.git"
            if os.path.isdir(here):
                return cls(at, here)
            if (link := _file(here)) and link.startswith(b"gitdir:"):  # a linked working copy, or a submodule
                return cls(at, os.path.normpath(os.path.join(at, link[7:].decode().strip())))
            if at == (at := os.path.dirname(at)):
                return None

    def _reference(self, name: str) -> str | None:
        for folder in (self.folder, self.common):
            if text := _file(f"{folder}/{name}"):
                value = text.decode().strip()
                return self._reference(value[5:].strip()) if value.startswith("ref:") else value
        for line in (_file(f"{self.common}/packed-refs") or b"").decode().splitlines():
            if line[:1] not in "#^" and line[41:] == name:
                return line[:40]
        return None

    def head(self) -> tuple[str | None, str | None]:
        """The commit and the branch."""
        text = (_file(f"{self.folder}/HEAD") or b"").decode().strip()
        branch = text[5:].strip().removeprefix("refs/heads/") if text.startswith("ref:") else None
        return self._reference("HEAD"), branch

    def commit(self, name: str) -> tuple[str, list[str], str]:
        """Tree, parents and the message's first line."""
        head, _, message = self.objects.read(bytes.fromhex(name))[1].partition(b"\n\n")
        fields = [line.split(b" ", 1) for line in head.split(b"\n")]
        return next(v.decode() for k, v in fields if k == b"tree"), [v.decode() for k, v in fields if k == b"parent"], message.decode(errors="replace").split("\n")[0]

    def first_commits(self, head: str) -> list[str]:
        """Commits without parents that ``head`` descends from."""
        cut = set((_file(f"{self.common}/shallow") or b"").decode().split())
        seen, todo, found = {head}, [head], []
        while todo:
            name = todo.pop()
            parents = [] if name in cut else self.commit(name)[1]
            if not parents:
                found.append(name)
            for p in parents:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return sorted(found)

    def remotes(self) -> list[str]:
        """Addresses that aren't paths of this machine, in one form."""
        out, remote = set(), False
        for line in (_file(f"{self.common}/config") or b"").decode(errors="replace").splitlines():
            line = line.strip()
            if line.startswith("["):
                remote = line.lower().startswith("[remote ")
            elif remote and (m := re.match(r"(?:push)?url\s*=\s*(\S.*)", line, re.I)):
                url = m[1].strip('"').replace("git@github.com:", "https://github.com/").removesuffix(".git")
                if not url.startswith(("/", "file:")):
                    out.add(url)
        return sorted(out)

    def tree(self, name: str, above: str = "") -> Iterator[tuple[str, bytes]]:
        """Paths and blobs of a tree."""
        body, at = self.objects.read(bytes.fromhex(name))[1], 0
        while at < len(body):
            end = body.index(b"\0", at)
            mode, _, file = body[at:end].partition(b" ")
            blob, at = body[end + 1 : end + 21], end + 21
            path = above + file.decode(errors="surrogateescape")
            if mode == b"40000":
                yield from self.tree(blob.hex(), path + "/")
            else:
                yield path, blob

    def index(self) -> dict[str, tuple[bytes, int, int]]:
        """Blob, mode and stage of each path; of one in conflict the first stage."""
        data = _file(f"{self.folder}/index") or b"DIRC\0\0\0\2\0\0\0\0"
        version, n = struct.unpack(">II", data[4:12])
        out, at, before = {}, 12, b""
        for _ in range(n):
            start, mode = at, struct.unpack(">I", data[at + 24 : at + 28])[0]
            blob, flags = data[at + 40 : at + 60], struct.unpack(">H", data[at + 60 : at + 62])[0]
            at += 64 if version > 2 and flags & 0x4000 else 62
            if version == 4:  # a path is the one before, less so many bytes, and what follows
                cut = data[at] & 127
                while data[at] & 128:
                    at += 1
                    cut = (cut + 1 << 7) | (data[at] & 127)
                at += 1
                end = data.index(b"\0", at)
                path = before[: len(before) - cut] + data[at:end]
                at = end + 1
            else:
                path = data[at : data.index(b"\0", at)]
                at = start + (at - start + len(path) + 8 & ~7)
            before = path
            out.setdefault(path.decode(errors="surrogateescape"), (blob, mode, flags >> 12 & 3))
        return out

    def paths(self) -> list[tuple[str, bytes | None, bytes | None, int, int]]:
        """Each tracked path with the head's and the index's blob, mode and stage."""
        head = self.head()[0]
        old, now = dict(self.tree(self.commit(head)[0])) if head else {}, self.index()
        return [(p, old.get(p), *(now.get(p) or (None, 0, 0))) for p in sorted({*old, *now})]

    def state(self, path: str, old: bytes | None, blob: bytes | None, mode: int, stage: int) -> tuple[str | None, bool, str]:
        """A path's content hash, whether it is dirty, and its status."""
        at = f"{self.root}/{path}"
        if mode == _MODULE:
            return None, old != blob, "module"
        content = os.fsencode(os.readlink(at)) if os.path.islink(at) else _file(at)
        hashed = hashlib.sha256(content).hexdigest() if content is not None else None
        if blob is None or content is None:
            return hashed, True, "deleted"
        own = hashlib.sha1(b"blob %d\0" % len(content) + content).digest()
        status = "conflict" if stage else "modified" if own != blob else "added" if old is None else "staged" if old != blob else "clean"
        return hashed, status != "clean", status

    def checkout(self) -> tuple:
        """The row of ``CHECKOUTS``."""
        (head, branch), remotes = self.head(), self.remotes()
        roots = self.first_commits(head) if head else []
        lineage = digest({"git_roots": roots}) if roots else None
        name = digest({"remotes": remotes}) if remotes else lineage or digest({"local": self.root})
        dirty = [(p, s, h) for p, *entry in self.paths() for h, odd, s in [self.state(p, *entry)] if odd]
        return self.root, name, lineage, head, branch, self.commit(head)[2] if head else None, roots, remotes, digest(dirty)


class Part(InputPartition):
    """One of so many parts of a root's paths."""

    def __init__(self, root: str, part: int):
        super().__init__((root, part))
        self.root, self.part = root, part


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "checkouts")
        self.roots = sorted({r.strip() for r in options.get("roots", "").splitlines() if r.strip()})
        self.parts = max(1, int(options.get("parts", "4"))) if self.table == "worktree" else 1

    def partitions(self) -> list[Part]:
        return [Part(r, k) for r in self.roots for k in range(self.parts)] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        own = Repository.around(partition.root) if partition.root else None
        if own is None:
            return
        if self.table == "checkouts":
            yield own.checkout()
            return
        for path, *entry in own.paths()[partition.part :: self.parts]:
            yield own.root, path, *own.state(path, *entry)


class GitRepositories(DataSource):
    """Register with ``spark.dataSource.register(GitRepositories)``."""

    @classmethod
    def name(cls) -> str:
        return "git_repositories"

    def schema(self) -> str:
        return WORKTREE if self.options.get("table") == "worktree" else CHECKOUTS

    def reader(self, schema) -> Reader:
        return Reader(self.options)

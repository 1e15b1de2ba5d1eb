"""Token-id files of shuffled planes.

Ids are cut into chunks of a fixed number. A chunk's little-endian uint32 values are transposed, so that
the first plane holds the first byte (or bit) of every id, the next plane the second, and so on; each
plane is compressed with zstandard on its own. High planes of small ids are all zero and vanish. Behind
the chunks stand the documents (id and number of ids of each), then the chunk index: number of ids and
the place of every plane. The last bytes say where these begin, so a reader can seek to any chunk.

    "BPS1" | planes of chunk 0 | planes of chunk 1 | ... | documents | index | footer
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"BPS1"
CHUNK_IDS = 1 << 16
_FOOTER = struct.Struct("<QQQQIB3s4s")  # documents, index, number of documents, of ids, ids of a chunk, planes, pad, magic


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of some ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4")[:, 0] if n else np.zeros(0, "<u4")
    bits = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u4")[:, 0] if n else np.zeros(0, "<u4")


class Writer:
    """Writes documents' ids to a binary stream, holding one chunk at a time."""

    def __init__(self, out, planes: int = 4, chunk_ids: int = CHUNK_IDS, level: int = 3):
        if planes not in (4, 32):
            raise ValueError("planes are 4 (bytes) or 32 (bits)")
        self.out, self.planes, self.chunk_ids = out, planes, chunk_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.total = len(MAGIC), 0
        self.index: list[tuple[int, ...]] = []
        self.buffer, self.held = [], 0
        self.docs: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.buffer.append(ids)
        self.held += len(ids) // 4
        self.total += len(ids) // 4
        if self.held >= self.chunk_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.buffer), "<u4")
        end = len(ids) if last else len(ids) - len(ids) % self.chunk_ids
        for i in range(0, end, self.chunk_ids):
            piece = ids[i:min(i + self.chunk_ids, end)]
            places = [len(piece), self.at]
            for plane in to_planes(piece, self.planes):
                data = self.zip.compress(plane)
                self.out.write(data)
                self.at += len(data)
                places.append(self.at)
            self.index.append(tuple(places))
        self.buffer, self.held = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        docs = np.array(self.docs, np.int64).reshape(-1, 3)
        data = self.zip.compress(np.ascontiguousarray(docs.T).tobytes())
        begin = self.at
        self.out.write(data)
        self.out.write(np.array(self.index, "<u8").tobytes())
        self.out.write(_FOOTER.pack(begin, begin + len(data), len(docs), self.total, self.chunk_ids, self.planes, b"", MAGIC))


class Reader:
    """Reads a file by its index; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - _FOOTER.size)
        docs_at, index_at, n_docs, self.total, self.chunk_ids, planes, _, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(docs_at)
        self.zip = zstandard.ZstdDecompressor()
        docs = np.frombuffer(self.zip.decompress(source.read(index_at - docs_at)), np.int64).reshape(3, n_docs)
        self.doc_ids = [i if has else None for i, has in zip(docs[0].tolist(), docs[1].tolist())]
        self.lengths = docs[2]
        self.index = np.frombuffer(source.read(end - _FOOTER.size - index_at), "<u8").reshape(-1, planes + 2).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        n, *places = self.index[k].tolist()
        self.source.seek(places[0])
        raw = self.source.read(places[-1] - places[0])
        return from_planes([self.zip.decompress(raw[a - places[0]:b - places[0]]) for a, b in zip(places, places[1:])], n)

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids), chunk by chunk."""
        held, at, start, k = b"", 0, 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            if len(held) - at < 4 * n:
                parts, have = [held[at:]], len(held) - at
                while have < 4 * n:
                    parts.append(self.chunk(k).tobytes())
                    have += len(parts[-1])
                    k += 1
                held, at = b"".join(parts), 0
            yield doc_id, start, held[at:at + 4 * n]
            at += 4 * n
            start += n

"""Signing keys: held by driver and task closures, never a column; their text form shows the key id only."""

from __future__ import annotations

import hmac
import os
import stat
import struct
import time
from pathlib import Path
from typing import Protocol

from .errors import KeyLoadError, SigningError

#: Fixed values of BLAKE3 (the first eight are SHA-256's initial state).
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
MIXED = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
CHUNK_START, CHUNK_END, ROOT = 1, 2, 8


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash of up to one chunk (1,024 bytes), which is all that key ids need."""
    if len(data) > 1024:
        raise ValueError("only one chunk is supported")
    turn = lambda x, n: ((x >> n) | (x << (32 - n))) & 0xFFFFFFFF
    chain = list(IV)
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for at, block in enumerate(blocks):
        flags = (CHUNK_START if at == 0 else 0) | (CHUNK_END | ROOT if at == len(blocks) - 1 else 0)
        m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        v = [*chain, *IV[:4], 0, 0, len(block), flags]
        for _ in range(7):
            for i, (a, b, c, d) in enumerate(MIXED):
                for word, (r1, r2) in zip(m[2 * i : 2 * i + 2], ((16, 12), (8, 7))):
                    v[a] = (v[a] + v[b] + word) & 0xFFFFFFFF
                    v[d] = turn(v[d] ^ v[a], r1)
                    v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                    v[b] = turn(v[b] ^ v[c], r2)
            m = [m[i] for i in PERMUTATION]
        chain = [v[i] ^ v[i + 8] for i in range(8)]
    return struct.pack("<8I", *chain)


class Key(Protocol):
    """What sealing and verifying need; must pickle, as tasks sign."""

    key_id: bytes

    def sign(self, data: bytes) -> bytes: ...


class LocalKey:
    """An HMAC-SHA256 key of 32 bytes."""

    def __init__(self, secret: bytes, key_id: bytes | None = None):
        if len(secret) != 32:
            raise KeyLoadError(f"a key has 32 bytes, not {len(secret)}")
        self._secret, self.key_id = bytes(secret), key_id or blake3(secret)

    def sign(self, data: bytes) -> bytes:
        return hmac.digest(self._secret, data, "sha256")

    def __repr__(self) -> str:
        return f"LocalKey(key_id={self.key_id.hex()[:8]}...)"

    @classmethod
    def from_hex(cls, text: str) -> LocalKey:
        try:
            return cls(bytes.fromhex(text.strip()))
        except ValueError:
            raise KeyLoadError("a key in text form is 64 hexadecimal digits") from None

    @classmethod
    def from_env(cls, variable: str) -> LocalKey:
        if variable not in os.environ:
            raise KeyLoadError(f"the environment has no {variable}")
        return cls.from_hex(os.environ[variable])

    @classmethod
    def from_file(cls, path: str) -> LocalKey:
        """32 raw bytes or 64 digits; refuses a file that group or others may read."""
        try:
            mode, data = stat.S_IMODE(os.stat(path).st_mode), Path(path).read_bytes()
        except OSError as e:
            raise KeyLoadError(str(e)) from None
        if mode & 0o077:
            raise KeyLoadError(f"{path} has mode {mode:o}; 600 is the widest allowed")
        return cls(data) if len(data) == 32 else cls.from_hex(data.decode("ascii", "replace"))


class RemoteClient(Protocol):
    provider_name: str
    descriptor: str

    def sign(self, data: bytes) -> bytes: ...

    def unwrap(self) -> bytes: ...


class RemoteKey:
    """Signs by a remote service; each Python worker makes its own client. Retryable failures are tried again."""

    def __init__(self, make_client, domain: bytes, tries: int = 3, wait_s: float = 0.05):
        client = make_client()
        self._make, self._client, self.tries, self.wait_s = make_client, None, tries, wait_s
        self.key_id = blake3(domain + client.provider_name.encode() + b"\n" + client.descriptor.strip().lower().encode())

    def __getstate__(self):
        return self.__dict__ | {"_client": None}

    def sign(self, data: bytes) -> bytes:
        self._client = self._client or self._make()
        for left in reversed(range(self.tries)):
            try:
                return self._client.sign(data)
            except SigningError as e:
                if not e.retryable or not left:
                    raise
                time.sleep(self.wait_s)
        raise SigningError("no tries")

    def local(self) -> LocalKey:
        """Envelope mode: the unwrapped data key, under this key's id."""
        return LocalKey(self._make().unwrap(), self.key_id)

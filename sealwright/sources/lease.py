"""One writer a store: a lease that is taken by creating a file that must not be there, with a token that grows.

A writer whose lease was broken is refused before its files are put in place: tasks compare the token they were given with
the lease's. Stores whose file system can't create a file exclusively (object stores) are refused, not silently shared.
"""

from __future__ import annotations

import json
import os
import uuid

from ..errors import SealError
from .segments import durable, filesystem

LEASE = "_sealed/lease"


class LeaseHeldError(SealError):
    """Another writer holds the store; break_lease() is for when that writer is known to be gone."""


def _read(fs, path: str) -> dict | None:
    from pyarrow import fs as pafs

    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as source:
        return json.loads(source.read() or b"{}")


def check_token(fs, base: str, token: str | None) -> None:
    """Raises unless the token is that of the lease; None stands for a writer that asked for no lease."""
    if token is not None and ((found := _read(fs, f"{base}/{LEASE}")) is None or found.get("token") != token):
        raise SealError("the store's lease has passed to another writer")


class Lease:
    """A context in which the store has this one writer."""

    def __init__(self, folder: str, owner: str = ""):
        self.folder, self.owner, self.token = folder, owner or f"process {os.getpid()}", uuid.uuid4().hex

    def __enter__(self) -> Lease:
        fs, base = filesystem(self.folder)
        if fs.type_name != "local":
            raise SealError(f"no lease on a {fs.type_name} file system: it can't create a file exclusively")
        fs.create_dir(f"{base}/_sealed")
        path = f"{base}/{LEASE}"
        whole = f"{path}.{self.token}"
        with fs.open_output_stream(whole, compression=None) as out:
            out.write(json.dumps({"owner": self.owner, "token": self.token}).encode())
        durable(fs, whole)
        try:
            os.link(whole, path)  # atomic, and fails where the lease is: it is never seen half written
        except FileExistsError:
            raise LeaseHeldError(f"{(_read(fs, path) or {}).get('owner', 'a writer')} holds {self.folder}") from None
        finally:
            fs.delete_file(whole)
        durable(fs, f"{base}/_sealed")
        return self

    def __exit__(self, *exc) -> None:
        fs, base = filesystem(self.folder)
        if (_read(fs, f"{base}/{LEASE}") or {}).get("token") == self.token:
            fs.delete_file(f"{base}/{LEASE}")


def break_lease(folder: str) -> dict | None:
    """Ends the lease of a writer that is gone, and returns it."""
    fs, base = filesystem(folder)
    found = _read(fs, f"{base}/{LEASE}")
    if found is not None:
        fs.delete_file(f"{base}/{LEASE}")
    return found

"""Byte streams of files wherever they are: local disks, HTTP(S), and the stores that Arrow's file systems reach.

A stream is read from its start on, in one task. HTTP reads go on where a connection broke off, by ranges.
"""

from __future__ import annotations

import glob
import io
import os
import shutil
from collections.abc import Callable
from fnmatch import fnmatch
from typing import BinaryIO
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from pyarrow import fs

#: Attempts at a read, and seconds to wait for an answer and for a connection.
ATTEMPTS, ANSWER, CONNECT = 3, 120.0, 30.0

Opener = Callable[[Request, float], BinaryIO]


def _urlopen(request: Request, timeout: float) -> BinaryIO:
    return urlopen(request, timeout=timeout)  # noqa: S310


class Ranged(io.RawIOBase):
    """A URL's bytes in order; a read that fails is tried again from its place on, ATTEMPTS times in a row at most."""

    def __init__(self, url: str, opener: Opener = _urlopen) -> None:
        self.url, self.opener, self.at = url, opener, 0
        self.answer: BinaryIO | None = None
        self.length: int | None = None

    def readable(self) -> bool:
        return True

    def _open(self) -> BinaryIO:
        headers = {"User-Agent": "syndilake"} | ({"Range": f"bytes={self.at}-"} if self.at else {})
        answer = self.opener(Request(self.url, headers=headers), ANSWER)
        own = getattr(answer, "headers", None) or {}
        if self.at and getattr(answer, "status", 206) != 206:  # the server starts anew
            skipped = 0
            while skipped < self.at and (data := answer.read(min(1 << 20, self.at - skipped))):
                skipped += len(data)
        elif self.length is None and not self.at and own.get("Content-Length"):
            self.length = int(own["Content-Length"])
        return answer

    def readinto(self, out: memoryview) -> int:
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                self.answer = self.answer or self._open()
                data = self.answer.read(len(out))
                if not data and self.length is not None and self.at < self.length:
                    raise ConnectionError("the answer broke off")
                out[: len(data)] = data
                self.at += len(data)
                return len(data)
            except OSError:
                self.answer = None
                if not left:
                    raise
        return 0


def file_system(uri: str, region: str | None = None, anonymous: bool = False, endpoint: str | None = None) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI, and the path in it. s3a and s3n are s3."""
    parts = urlsplit(uri)
    if parts.scheme in ("s3", "s3a", "s3n"):
        retries = fs.AwsStandardS3RetryStrategy(max_attempts=ATTEMPTS)
        return fs.S3FileSystem(region=region, anonymous=anonymous, endpoint_override=endpoint, request_timeout=ANSWER, connect_timeout=CONNECT, retry_strategy=retries), parts.netloc + parts.path
    if parts.scheme == "file":
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def opened(path: str, **options: object) -> BinaryIO:
    """A stream of a file's bytes."""
    if path.startswith(("http://", "https://")):
        return io.BufferedReader(Ranged(path), 1 << 20)
    if "://" in path:
        system, own = file_system(path, **options)
        return system.open_input_stream(own, compression=None)
    return open(path, "rb")


def listed(pattern: str, **options: object) -> list[str]:
    """Paths that a pattern with * or ? stands for, in order; itself if there are none or nothing can be listed, as by HTTP."""
    if not any(c in pattern for c in "*?[") or pattern.startswith(("http://", "https://")):
        return [pattern]
    if "://" not in pattern:
        return sorted(glob.glob(pattern)) or [pattern]
    system, own = file_system(pattern, **options)
    base = os.path.dirname(own.split("*")[0].split("?")[0].split("[")[0])
    head = pattern[: len(pattern) - len(own)] if pattern.endswith(own) else pattern.split("://")[0] + "://"
    found = system.get_file_info(fs.FileSelector(base or "/", recursive=True, allow_not_found=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and fnmatch(f.path, own)) or [pattern]


def download(url: str, to: str, opener: Callable[[str], BinaryIO] = opened) -> str:
    """Copies a file here; nothing is left of a copy that fails."""
    part = f"{to}.download"
    try:
        with opener(url) as source, open(part, "wb") as target:
            shutil.copyfileobj(source, target, 1 << 20)
        os.replace(part, to)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return to

"""Repositories fetched from GitHub: one commit, without history, put where executors can read it."""

from __future__ import annotations

import base64
import os
import re
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession

from cipherlode.runtime import remove, work_folder

_ADDRESS = re.compile(r"https://github\.com/+([^/?#]+)/+([^/?#]+)", re.IGNORECASE)


class FetchError(RuntimeError):
    """git said no."""


@dataclass(frozen=True)
class GitHubRepository:
    """owner/name at a branch, tag or commit; none is the default branch."""

    owner: str
    name: str
    ref: str = ""
    depth: int = 1
    token: str = ""

    @classmethod
    def at(cls, address: str, ref: str = "", depth: int = 1, token: str | None = None) -> GitHubRepository:
        """From an https://github.com/OWNER/NAME address; the token is GITHUB_TOKEN's unless given."""
        found = _ADDRESS.match(address)
        if not found:
            raise ValueError(f"not an https://github.com/OWNER/NAME address: {address!r}")
        known = os.environ.get("GITHUB_TOKEN", "") if token is None else token
        return cls(found[1], found[2], ref.strip(), max(1, depth), known.strip())

    @property
    def address(self) -> str:
        return f"https://github.com/{self.owner}/{self.name}"

    def credentials(self) -> dict[str, str]:
        """git's settings by environment: the token goes into a header, so no command, address or file has it."""
        if not self.token:
            return {"GIT_TERMINAL_PROMPT": "0"}
        secret = base64.b64encode(f"x-access-token:{self.token}".encode()).decode()
        return {"GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.https://github.com/.extraheader", "GIT_CONFIG_VALUE_0": f"Authorization: Basic {secret}"}

    def steps(self) -> Iterator[list[str]]:
        """What git is asked, one after another, inside an empty folder."""
        yield ["init", "--quiet"]
        yield ["fetch", "--quiet", "--no-tags", f"--depth={self.depth}", self.address, self.ref or "HEAD"]
        yield ["checkout", "--quiet", "--detach", "FETCH_HEAD"]

    def fetch(self, folder: str, run: Callable = subprocess.run) -> None:
        """Put the files into a folder. run carries out a command, so that a test needs no network."""
        for step in self.steps():
            done = run(["git", "-C", folder, *step], env={**os.environ, **self.credentials()}, capture_output=True, text=True)
            if done.returncode:
                said = (done.stderr or "").strip() or f"exit code {done.returncode}"
                raise FetchError(f"{self.owner}/{self.name}: git {step[0]}: {said}")

    @contextmanager
    def fetched(self, spark: SparkSession, keep: bool = False, run: Callable = subprocess.run) -> Iterator[str]:
        """A folder with the files that driver and executors can read, gone afterwards unless kept.

        In local mode that is where git puts them; on a cluster they are copied to the shared work folder.
        """
        with tempfile.TemporaryDirectory(prefix="cipherlode-git-", delete=not keep) as folder:
            self.fetch(folder, run)
            if spark.sparkContext.master.partition("[")[0] == "local":
                yield folder
                return
            shared = publish(spark, folder)
            try:
                yield shared
            finally:
                if not keep:
                    remove(spark, shared)


def publish(spark: SparkSession, folder: str) -> str:
    """A copy of a driver's folder, without git's own files, in the shared work folder."""
    target = f"{work_folder(spark)}/cipherlode-git-{uuid.uuid4().hex[:12]}"
    system, top = fs.FileSystem.from_uri(target) if ":" in target else (fs.LocalFileSystem(), target)
    own = fs.LocalFileSystem()
    for entry in sorted(Path(folder).iterdir()):
        if entry.name == ".git" or entry.is_symlink():
            continue
        system.create_dir(f"{top}/{entry.name}" if entry.is_dir() else top, recursive=True)
        fs.copy_files(str(entry), f"{top}/{entry.name}", source_filesystem=own, destination_filesystem=system)
    return target

"""Job options from an INI file.

Sections PATH (input, output, force), COMPUTING (threads, cache, batch) and SYNC (interval) are read;
unknown keys are kept in ``other``. Cache, batch, stealing and sync settings have no effect: Spark's
scheduler, shuffle and memory manager do that work. A force setting takes effect wherever it stands.
"""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field


@dataclass(frozen=True)
class JobOptions:
    input: str | None = None
    output: str | None = None
    force: bool = True
    threads: int | None = None
    other: dict[str, str] = field(default_factory=dict)

    def spark_conf(self) -> dict[str, str]:
        """Settings for a session builder."""
        return {} if self.threads is None else {"spark.executor.cores": str(self.threads)}


#: Names under which the known options may stand.
NAMES = {
    "input": ("input", "input_path", "hdfs_input_path"),
    "output": ("output", "output_path", "hdfs_output_path"),
    "force": ("force", "force_write"),
    "threads": ("threads", "num_comp_thread"),
}


def load(path: str) -> JobOptions:
    parser = configparser.ConfigParser(inline_comment_prefixes=(";", "#"), strict=False)
    with open(path, encoding="utf-8") as f:
        parser.read_string("[DEFAULTS]\n" + f.read())
    found = {k.lower(): v.strip() for section in parser.sections() for k, v in parser[section].items()}
    known: dict[str, str] = {}
    for name, keys in NAMES.items():
        for key in keys:
            if key in found:
                known[name] = found.pop(key)
    threads = known.get("threads")
    return JobOptions(known.get("input"), known.get("output"), known.get("force", "true").lower() in ("1", "true", "yes", "on"), int(threads) if threads else None, found)


def hosts(path: str) -> list[tuple[str, int]]:
    """(name, port) of every line ``name:port``; blank lines and what follows a # are skipped.

    Spark finds its executors by itself: the list is there for jobs that start a cluster from it.
    """
    found = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, colon, port = line.split("#")[0].strip().rpartition(":")
            if colon:
                found.append((name, int(port)))
    return found

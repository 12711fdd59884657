"""Settings of a store, from a dictionary, a YAML-like file or their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from logloom.functions.bloom import BloomConfig, optimal

#: Fixed names: nested keys of a store's configuration file, and the settings that they give.
NESTED = {
    "memtable.maxSize": "flush_bytes",
    "sstmanager.flushSize": "fan_in",
    "sstmanager.clearTime": "gc_period",
    "sstmanager.bloom.expectedElements": "bloom_keys",
    "sstmanager.bloom.falsePositiveRate": "bloom_fpr",
    "wal.walPrefix": "log_prefix",
    "sstPrefix": "run_prefix",
}


@dataclass(frozen=True)
class StoreConfig:
    """flush_bytes: of a segment before it is flushed. fan_in: runs that a compaction merges.
    gc_min_age: seconds before an unnamed file may go. gc_period: seconds between sweeps.
    bloom_fpr: of the run files' Parquet Bloom filters, and with bloom_keys of ``bloom``.
    log_prefix, run_prefix: names of binary log and run files. auto: a write flushes what has
    reached flush_bytes, and a flush compacts levels that are full."""

    flush_bytes: int = 64 << 20
    fan_in: int = 4
    gc_min_age: float = 3600.0
    gc_period: float = 5.0
    bloom_keys: int = 5_000_000
    bloom_fpr: float = 0.005
    index_step: int = 20
    auto: bool = False
    log_prefix: str = "wal_"
    run_prefix: str = "sst_"

    @property
    def bloom(self) -> BloomConfig:
        return optimal(self.bloom_keys, self.bloom_fpr)


def _settings(text: str) -> dict[str, str]:
    """Values by path of keys, joined by dots; a line that is indented deeper belongs to the key above it."""
    found, above = {}, []
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        key, colon, value = line.partition(":")
        if not colon:
            continue
        depth = len(key) - len(key.lstrip())
        above = [(d, k) for d, k in above if d < depth] + [(depth, key.strip())]
        if value.strip():
            found[".".join(k for _, k in above)] = value.strip().strip("\"'")
    return found


def load_config(path: str | None = None, env: str = "CONFIG_DIR") -> StoreConfig:
    """Settings of a file, flat by their own names or nested by those of NESTED; other keys are ignored.

    Without a path, the environment names the file, or the folder of a config.yaml; where it names
    none, all settings have their defaults.
    """
    if path is None and (path := os.environ.get(env)) and os.path.isdir(path):
        path = os.path.join(path, "config.yaml")
    if not path:
        return StoreConfig()
    types = {f.name: type(f.default) for f in fields(StoreConfig)}
    with open(path) as f:
        named = {NESTED.get(key, key): value for key, value in _settings(f.read()).items()}
    kinds = {k: types[k] for k in named if k in types}
    return StoreConfig(**{k: named[k].lower() == "true" if kind is bool else kind(named[k]) for k, kind in kinds.items()})

"""Flags of places that are rarely searched for, from the absolute path alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of noise_flags.
SYSTEM, BUILD, CACHE, HASHY, DEEP, APP_DATA, LOG = 1, 2, 4, 8, 16, 32, 64

# Roots and component names behind the flags.
SYSTEM_ROOTS = ["/usr/", "/lib/", "/lib64/", "/opt/", "/snap/", "/flatpak/", "/var/", "/etc/", "/sys/", "/proc/"]
BUILD_NAMES = [
    "node_modules", "target", "build", "dist", "out", ".next", ".git", ".hg", ".svn", ".venv", "venv",
    "site-packages", ".tox", "vendor", ".cargo",
]
CACHE_NAMES = [".cache", "cache", ".gradle", ".m2", ".npm", ".pip", "caches", "__pycache__"]
LOG_NAMES = ["logs", "log", "debug", "sessionstore-logs", "crash-reports", "crashreporter", "telemetry", "diagnostics"]

DEEP_ABOVE = 15
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda x: x != "")


def path_depth(path: Column) -> Column:
    return F.least(F.size(components(path)), F.lit(255))


def _hashy(part: Column) -> Column:
    """A UUID, or 16 to 64 bytes without separators of which more than 85 % are hex digits."""
    size = F.octet_length(part)
    hexes = F.length(F.regexp_replace(part, "[^0-9a-fA-F]", ""))
    run = size.between(16, 64) & ~F.rlike(part, F.lit("[-_.]")) & (hexes * 100 > size * 85)
    return F.rlike(part, F.lit(_UUID)) | run


def noise_flags(path: Column) -> Column:
    parts = components(path)
    any_of = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    system = F.lit(False)
    for root in SYSTEM_ROOTS:
        system = system | F.startswith(path, F.lit(root))
    hidden = F.transform(parts, lambda x: F.startswith(x, F.lit(".")) & ~x.isin(".", ".."))
    first_hidden = F.array_position(hidden, True)  # 1-based, 0 for none
    checks = {
        SYSTEM: system,
        BUILD: any_of(BUILD_NAMES),
        CACHE: any_of(CACHE_NAMES),
        HASHY: F.exists(parts, _hashy),
        DEEP: F.size(parts) > DEEP_ABOVE,
        APP_DATA: (first_hidden > 0) & (first_hidden <= F.size(parts) - 2),
        LOG: any_of(LOG_NAMES),
    }
    total = F.lit(0)
    for bit, check in checks.items():
        total = total + F.when(check, bit).otherwise(0)
    return total

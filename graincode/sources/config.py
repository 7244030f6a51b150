"""Endpoints, settings and where they come from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Port of the shared store, and the modes of storage.
DEFAULT_PORT = 6334
MODES = ("local", "shared", "hybrid")


def parse_endpoint(url: Column) -> tuple[Column, Column]:
    """Host and port of host[:port] with or without a scheme; a port that is no number belongs to the host."""
    rest = F.regexp_replace(url, r"^https?://", "")
    port = F.regexp_extract(rest, r":(\d+)$", 1)
    given = port != ""
    return F.when(given, F.regexp_replace(rest, r":\d+$", "")).otherwise(rest), F.coalesce(port.try_cast("int"), F.lit(DEFAULT_PORT))


def first_set(*tiers: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tiers])


def settings_error(mode: Column, local_path: Column, shared_url: Column, token: Column) -> Column:
    """What settings of storage lack, by mode (whatever its case; local if it is empty); null where nothing is missing."""
    own = F.lower(first_set(mode, F.lit(MODES[0])))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    lacks = F.when(own.isin("local", "hybrid") & blank(local_path), F.concat(own, F.lit(" mode needs a local path")))
    lacks = lacks.when(own.isin("shared", "hybrid") & blank(shared_url), F.concat(own, F.lit(" mode needs a shared address")))
    return lacks.when((own == "shared") & blank(token), F.lit("shared mode needs a token")).when(~own.isin(*MODES), F.concat(F.lit("unknown mode "), own))


@dataclass(frozen=True)
class Settings:
    """Settings of storage, after defaults."""

    mode: str = "local"
    local_path: str = ""
    shared_url: str = ""
    token: str = ""
    exclude: tuple[str, ...] = ()

    def check(self) -> "Settings":
        """Itself; ValueError where something is missing. The rules are those of ``settings_error``."""
        needs = {"local": ("local_path",), "shared": ("shared_url", "token"), "hybrid": ("local_path", "shared_url")}.get(self.mode)
        if needs is None:
            raise ValueError(f"unknown mode {self.mode}; there are {', '.join(MODES)}")
        missing = [n for n in needs if not getattr(self, n)]
        if missing:
            raise ValueError(f"{self.mode} mode needs {missing[0]}")
        return self


def settings(env: Mapping[str, str], file: Mapping | None = None, prefix: str = "GRAINCODE_", home: str | None = None) -> Settings:
    """Settings by precedence: the environment, the file, a path derived from its state_dir, the default. Empty values count as none."""
    file = file or {}
    own = file.get("storage") or {}
    pick = lambda name, *more: next((v for v in (env.get(prefix + name.upper()), own.get(name), *more) if v), "")
    state = file.get("state_dir")
    path = pick("local_path", f"{state}/vectors" if state else None, f"{home or Path.home()}/.local/share/graincode/vectors")
    exclude = (file.get("indexing") or {}).get("exclude") or ()
    return Settings(pick("mode", MODES[0]).lower(), path, pick("shared_url"), pick("token"), tuple(exclude)).check()


def find_config(start: str, names: tuple[str, ...]) -> Path | None:
    """The first of names in a folder or the nearest of its parents."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for n in names:
            if (folder / n).is_file():
                return folder / n
    return None


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    text = text.split(" #", 1)[0].strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), int(text) if text.lstrip("-").isdigit() else text)


def parse_yaml(text: str) -> dict:
    """The YAML that settings use: nested mappings by indentation, lists of plain values, quoted and bare scalars, comments."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, depth: int):
        out: dict | list = [] if rows[at][1].startswith("- ") else {}
        while at < len(rows) and rows[at][0] == depth:
            row = rows[at][1]
            if isinstance(out, list):
                if not row.startswith("- "):
                    break  # the next key of the mapping that holds the list
                out.append(_scalar(row[2:]))
                at += 1
                continue
            key, colon, rest = row.partition(":")
            if not colon or row.startswith("- "):
                raise ValueError(f"not a setting: {row}")
            at, value = at + 1, rest
            deeper = at < len(rows) and (rows[at][0] > depth or rows[at][0] == depth and rows[at][1].startswith("- "))
            if not rest.split(" #", 1)[0].strip() and deeper:
                out[_scalar(key)], at = block(at, rows[at][0])
            else:
                out[_scalar(key)] = _scalar(value)
        return out, at

    if not rows:
        return {}
    out, at = block(0, rows[0][0])
    if at < len(rows) or not isinstance(out, dict):
        raise ValueError(f"not a setting: {rows[min(at, len(rows) - 1)][1]}")
    return out


def load_config(path: str | Path) -> dict:
    return parse_yaml(Path(path).read_text(encoding="utf-8"))

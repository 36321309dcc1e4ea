"""A sample's folder: what is in it, and whether that is what should be."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field
from pathlib import Path


class ValidationError(Exception):
    pass


#: What a sample's folder must (+) hold or must not (-), by subfolder; anything else may be there.
LAYOUT = {
    "": ["+run_meta.json", "+samplesheet.csv", "+summary_{sample_id}.html", "+*_panel.csv"],
    "diagnostics": ["-transcript_table.parquet"],
    "h_and_e": ["+h_and_e.*", "+nuclear.*"],
    "rna": ["+transcript_table.csv.gz", "+raw_features.parquet"],
    "segmentation": ["+segmentation_mask.npz"],
    "single_cell_data": ["+feature_matrix*"],
}
#: Fixed value: folders that a sample may lack.
OPTIONAL_FOLDERS = ("diagnostics",)


@dataclass
class Report:
    missing: list[str] = field(default_factory=list)
    forbidden: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.missing and not self.forbidden

    def text(self, long: bool = False) -> str:
        lines = [f"missing: {x}" for x in self.missing] + [f"not allowed: {x}" for x in self.forbidden]
        if long:
            lines += [f"also there: {x}" for x in self.extra]
        return "\n".join(lines) or "the folder is as it should be"


def check_layout(root: str | Path, sample_id: str, layout: dict[str, list[str]] = LAYOUT) -> Report:
    root, out = Path(root), Report()
    for folder, rules in layout.items():
        at = root / folder
        if not at.is_dir():
            if folder not in OPTIONAL_FOLDERS:
                out.missing.append(f"{folder}/")
            continue
        have = sorted(p.name for p in at.iterdir())
        named = set()
        for rule in rules:
            pattern = rule[1:].format(sample_id=sample_id)
            hits = fnmatch.filter(have, pattern)
            named.update(hits)
            where = f"{folder}/{pattern}" if folder else pattern
            if rule[0] == "+" and not hits:
                out.missing.append(where)
            if rule[0] == "-":
                out.forbidden += [f"{folder}/{h}" if folder else h for h in hits]
        out.extra += [f"{folder}/{h}" if folder else h for h in have if h not in named and not (folder == "" and h in layout)]
    return out


def require_layout(root: str | Path, sample_id: str, long: bool = False) -> Report:
    r = check_layout(root, sample_id)
    if not r.ok:
        raise ValidationError(r.text(long))
    return r


def infer_sample_id(root: str | Path) -> str:
    """From the one summary page of the folder."""
    pages = sorted(Path(root).glob("summary_*.html"))
    if len(pages) != 1:
        raise ValidationError(f"{len(pages)} summary pages in {root}, not one")
    return pages[0].stem.removeprefix("summary_")


def viewer_folder(root: str | Path) -> Path:
    """The sample's viewer folder: the one whose name ends in ``_viewer``, else ``viewer``."""
    found = sorted(p for p in Path(root).glob("*_viewer") if p.is_dir())
    return found[0] if found else Path(root) / "viewer"


def list_content(root: str | Path, subdir: str | None = None) -> dict[str, list[str]]:
    at = Path(root) / subdir if subdir else Path(root)
    entries = sorted(at.iterdir())
    return {"dirs": [p.name for p in entries if p.is_dir()], "files": [p.name for p in entries if p.is_file()]}


def check_path(path: str | Path, must_exist: bool = True, dir_ok: bool = True, file_ok: bool = True) -> Path:
    """The path, made a folder if it may be one and is not there."""
    p = Path(path)
    if p.exists():
        if p.is_dir() and not dir_ok:
            raise IsADirectoryError(p)
        if p.is_file() and not file_ok:
            raise NotADirectoryError(p)
    elif must_exist:
        raise FileNotFoundError(p)
    elif dir_ok and not p.suffix:
        p.mkdir(parents=True, exist_ok=True)
    return p


def output_tree(root: str | Path, *subdirs: str) -> dict[str, Path]:
    """Folders for results, made where needed."""
    out = {d: Path(root) / d for d in subdirs}
    for p in out.values():
        p.mkdir(parents=True, exist_ok=True)
    return out


def total_size_gb(files: list[str | Path]) -> float:
    """Size of the files, and of all in the folders, that exist."""
    size = 0
    for f in map(Path, files):
        size += sum(p.stat().st_size for p in f.rglob("*") if p.is_file()) if f.is_dir() else f.stat().st_size if f.exists() else 0
    return size / 1e9

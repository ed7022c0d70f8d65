"""Settings with their defaults, and presets by the size of the model they suit."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """One immutable set of settings; ``merge`` lays others over it."""

    top_k: int = 5
    rrf_k: int = 60
    semantic_weight: float = 0.6
    keyword_weight: float = 0.4
    context_window: int = 2000
    ocr_dpi: int = 300
    ocr_threshold: float = 0.7
    review_below: float = 0.8
    rejected_below: float = 0.5
    batch_size: int = 32
    chunk_size: int = 512
    chunk_overlap: int = 50
    refine_rounds: int = 3
    output_dir: str = "output"

    def merge(self, **over: object) -> Settings:
        """With every value that is given and not None; unknown names are refused."""
        known = {f.name for f in fields(self)}
        if unknown := set(over) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **{k: v for k, v in over.items() if v is not None})


DEFAULT = Settings()
#: For models of under ten, under thirty, and more billion parameters.
PRESETS = {"small": DEFAULT.merge(top_k=3, chunk_size=384, refine_rounds=2), "default": DEFAULT, "large": DEFAULT.merge(top_k=10, chunk_size=1024, chunk_overlap=100)}


def preset(billions: float) -> Settings:
    return PRESETS["small" if billions < 10 else "default" if billions < 30 else "large"]


def merged_options(from_file: dict[str, object], from_command: dict[str, object]) -> dict[str, object]:
    """Options of a file under those of the command line, but for the output folder, where the file's stands."""
    out = {**from_file, **{k: v for k, v in from_command.items() if v is not None}}
    if from_file.get("output_dir"):
        out["output_dir"] = from_file["output_dir"]
    return out

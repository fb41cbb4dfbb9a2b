"""Settings of detection, profiling and policies."""

from __future__ import annotations

from dataclasses import dataclass, field

MODEL_TYPES = ("LOCATION", "ORGANIZATION", "PERSON")


@dataclass(frozen=True)
class Settings:
    """What is detected and how strictly; the defaults are those in use."""

    engagement_pattern: str = r"\b[A-Z]{2,4}-[0-9]{4,8}\b"  # to be tuned to real codes
    branch_pattern: str = r"\b[0-9]{3}-[0-9]{3}\b"
    account_pattern: str = r"\b[0-9]+(?:[ -][0-9]+)*\b"
    account_digits: tuple[int, int] = (6, 10)
    account_reach: int = 40  # characters between a branch code and an account number
    threshold: float = 0.4
    strict: bool = True  # drop spans without letters and model names with digits
    unicode: bool = False  # word borders and digits of all scripts, not ASCII alone
    most_segments: int = 20_000  # of one document
    types: tuple[str, ...] | None = None  # None: all
    extra: tuple = ()  # further detectors (``operators.detect.Detector``), after those that are built in
    context: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "AU_ABN": ("abn", "australian business number"),
            "AU_ACN": ("acn", "australian company number"),
            "AU_DRIVER_LICENCE": ("driver", "licence", "license"),
            "AU_PASSPORT": ("passport",),
            "AU_TFN": ("tfn", "tax file number"),
            "DATE_OF_BIRTH": ("born", "d.o.b", "dob", "date of birth"),
            "MEDICARE": ("medicare",),
        }
    )

    def wants(self, kind: str) -> bool:
        return self.types is None or kind in self.types

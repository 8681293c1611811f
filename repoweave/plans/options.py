"""Run parameters of a packing job."""

from __future__ import annotations

from dataclasses import dataclass, fields

from repoweave.functions import fixed
from repoweave.functions.redaction import CredentialPattern


@dataclass(frozen=True)
class PackOptions:
    """What to select, how much to keep and how to clean it.

    ``extensions``, ``files`` and ``exclude`` replace the defaults when given;
    ``ignore`` is added to them.  ``as_of`` is the time that ages count from.
    """

    extensions: tuple[str, ...] | None = None
    ignore: tuple[str, ...] = ()
    files: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    limit_bytes: int = fixed.SIZE_LIMIT_KB * fixed.KB
    token_limit_chars: int = fixed.TOKEN_LIMIT * fixed.CHARS_PER_TOKEN
    max_file_bytes: int = fixed.MAX_FILE_BYTES
    max_files: int = fixed.MAX_TOTAL_FILES
    recent_days: int | None = None
    as_of: str = "2024-03-01 00:00:00"
    smart: bool = False
    auto_detect: bool = False
    infrastructure: bool = False
    strip_comments: bool = False
    optimize_tokens: bool = False
    summarize_large_files: bool = False
    redact_credentials: bool = True
    show_redacted: bool = False
    # Credential patterns in place of the built-in ones.
    patterns: tuple[CredentialPattern, ...] | None = None
    respect_gitignore: bool = True
    strict_gitignore: bool = False
    tree: bool = False
    tool_name: str = "repoweave"
    # Hash buckets that a large repository is split into before its rows meet.
    salt_buckets: int = 64

    @property
    def needs_detection(self) -> bool:
        """Whether project detection can change which files are selected.

        The default lists already hold every extension that detection adds; the
        one added name is accepted by another rule, unless only recent files count.
        """
        if self.infrastructure:
            return False
        added_names = self.files is not None or bool(self.recent_days)
        return self.extensions is not None or (self.auto_detect and added_names)

    @classmethod
    def preset(cls, mode: str = "auto", security: str = "auto", **overrides) -> PackOptions:
        """Options for a project mode and a security level."""
        modes = {
            "auto": dict(auto_detect=True, smart=True, optimize_tokens=True, summarize_large_files=True),
            "code": dict(strip_comments=True, summarize_large_files=True, optimize_tokens=True),
            "infra": dict(
                infrastructure=True, auto_detect=True, optimize_tokens=True,
                extensions=tuple(fixed.INFRA_MODE_EXTENSIONS),
            ),
            "doc": dict(),
        }
        levels = {
            "strict": dict(redact_credentials=True, show_redacted=True, respect_gitignore=True),
            "auto": dict(redact_credentials=True, show_redacted=False, respect_gitignore=True),
            "none": dict(redact_credentials=False, show_redacted=False, respect_gitignore=False),
        }
        for given, known in ((mode, modes), (security, levels)):
            if given not in known:
                raise ValueError(f"unknown setting {given!r}; choose one of {sorted(known)}")
        return cls(**{**modes[mode], **levels[security], **overrides})

    @classmethod
    def from_dict(cls, saved: dict) -> PackOptions:
        """Options from a saved profile; unknown keys are an error."""
        known = {f.name for f in fields(cls)}
        unknown = set(saved) - known
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in saved.items()}
        if values.get("patterns") is not None:
            values["patterns"] = tuple(
                CredentialPattern(**{k: tuple(v) if isinstance(v, list) else v for k, v in dict(p).items()}) for p in values["patterns"]
            )
        return cls(**values)

    def to_dict(self) -> dict:
        """Plain values that a profile can hold; ``from_dict`` reads them."""
        plain = {f.name: getattr(self, f.name) for f in fields(self)}
        if self.patterns is not None:
            plain["patterns"] = tuple(p._asdict() for p in self.patterns)
        return plain

"""Settings that an engine is made with."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """``base_url`` and ``mirrors`` are the hosts that record URLs may begin with;
    ``key_prefix`` is dropped from keys that are no URLs; ``compat`` caps candidates
    before filtering, as a paged search service does, in place of searching the whole corpus."""

    base_url: str = "https://bib.example"
    mirrors: tuple[str, ...] = field(default_factory=tuple)
    key_prefix: str = "bib:"
    compat: bool = False

    def __post_init__(self) -> None:
        url = self.base_url if self.base_url.startswith(("https://", "http://")) else f"https://{self.base_url}"
        object.__setattr__(self, "base_url", url.rstrip("/"))

    @property
    def hosts(self) -> tuple[str, ...]:
        """The hosts in the order in which they are tried."""
        return (self.base_url, *(m for m in self.mirrors if m != self.base_url))


def whole_number(name: str, value: object, least: int = 0) -> int:
    """``value`` as an int that is not below ``least``; anything else is refused."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value!r}")
    return int(value)


def required(**given: object) -> None:
    """Refuse missing arguments by name."""
    missing = [name for name, value in given.items() if value is None]
    if missing:
        raise ValueError(f"missing required argument: {', '.join(missing)}")

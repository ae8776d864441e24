"""Source descriptions: typed, with defaults, tolerant of unknown keys; written back without their defaults."""

from __future__ import annotations

from dataclasses import MISSING, asdict, dataclass, field, fields


@dataclass(frozen=True)
class Part:
    """A section of a description. Keys in JSON are camel case."""

    @classmethod
    def key(cls, name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(w.capitalize() for w in rest)

    @classmethod
    def from_json(cls, data: dict):
        known = {cls.key(f.name): f.name for f in fields(cls)}
        for f in fields(cls):
            if f.default is MISSING and f.default_factory is MISSING and cls.key(f.name) not in data:
                raise KeyError(f"{cls.__name__} needs {cls.key(f.name)!r}")
        return cls(**{known[k]: v for k, v in data.items() if k in known})

    def to_json(self) -> dict:
        out = {}
        for f in fields(self):
            default = f.default if f.default is not MISSING else f.default_factory() if f.default_factory is not MISSING else MISSING
            value = getattr(self, f.name)
            if value != default:
                out[self.key(f.name)] = value
        return out

    @classmethod
    def unknown_keys(cls, data: dict) -> list[str]:
        return sorted(set(data) - {cls.key(f.name) for f in fields(cls)})


@dataclass(frozen=True)
class Listing(Part):
    path: str
    item_selector: str
    title_selector: str = "a"
    url_selector: str = "a"
    url_attr: str = "href"
    cover_selector: str = "img"
    cover_attr: str = "src"
    next_page_selector: str = ""
    page_size: int = 0


@dataclass(frozen=True)
class Chapters(Part):
    item_selector: str
    name_selector: str = "a"
    url_selector: str = "a"
    url_attr: str = "href"
    date_selector: str = ""
    reversed: bool = True


@dataclass(frozen=True)
class Pages(Part):
    image_selector: str
    image_attr: str = "src"


@dataclass(frozen=True)
class Rate(Part):
    requests: int = 1
    per_ms: int = 1000


@dataclass(frozen=True)
class Source(Part):
    id: str
    name: str
    base_url: str
    lang: str = ""
    headers: dict = field(default_factory=dict)
    popular: dict = field(default_factory=dict)
    chapters: dict = field(default_factory=dict)
    pages: dict = field(default_factory=dict)
    rate_limit: dict = field(default_factory=dict)

    def listing(self) -> Listing:
        return Listing.from_json(self.popular)

    def as_dict(self) -> dict:
        return asdict(self)


def lint(data: dict) -> list[str]:
    """Unknown keys and selectors that cannot be read, each with its place."""
    from gleaner.sources.html import read_selector

    found = [f"unknown key {k!r}" for k in Source.unknown_keys(data)]

    def walk(node, at: str) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                place = f"{at}.{k}" if at else k
                if k.endswith("Selector") and isinstance(v, str) and v:
                    try:
                        read_selector(v)
                    except (ValueError, NotImplementedError) as e:
                        found.append(f"{place}: {e}")
                if k == "steps" and any(isinstance(s, dict) and "js" in s for s in v) and not data.get("js"):
                    found.append(f"{place}: a js step needs \"js\": true")
                walk(v, place)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, f"{at}[{i}]")

    walk(data, "")
    return found

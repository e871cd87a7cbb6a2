"""Device profiles."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    name: str
    width: int
    height: int
    top: int
    right: int
    bottom: int
    left: int
    font_size: int
    line_height: float
    font_family: str

    @property
    def content(self) -> tuple[int, int]:
        return self.width - self.left - self.right, self.height - self.top - self.bottom

    def css(self, content_class: str = "book-content") -> str:
        """The page's size, its margins as padding and its type, over what a book says; spans are left as they are."""
        w, h = self.content
        body = f"padding: {self.top}px {self.right}px {self.bottom}px {self.left}px !important; font-family: {self.font_family} !important; font-size: {self.font_size}px !important; line-height: {self.line_height} !important;"
        return "\n".join(
            [
                f"html, body {{ width: {self.width}px !important; height: {self.height}px !important; overflow: hidden !important; }}",
                f"body {{ margin: 0 !important; {body} }}",
                f".{content_class} {{ width: {w}px !important; height: {h}px !important; overflow-y: scroll !important; overflow-x: hidden !important; }}",
            ]
        )


# The one device there is.
DEFAULT = Profile(name="supernote-manta-a5x2", width=1920, height=2560, top=100, right=80, bottom=200, left=80, font_size=48, line_height=1.5, font_family="'Noto Serif', serif")
PROFILES = {DEFAULT.name: DEFAULT}


def get(name: str | None = None) -> Profile:
    if not name:
        return DEFAULT
    if name not in PROFILES:
        raise ValueError(f"Unknown profile: {name}. Available: {', '.join(PROFILES)}")
    return PROFILES[name]

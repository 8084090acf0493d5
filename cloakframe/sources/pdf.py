"""A PDF decoder on top of pypdf, where that is installed on the workers."""

from __future__ import annotations

import io


def decode(content: bytes) -> tuple[list[tuple[str | Exception, list[tuple[str, str]]]], dict[str, str]]:
    """Pages as (text in layout mode, [(font, run)]) and the file's metadata; a page that fails is its exception."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    pages: list[tuple[str | Exception, list[tuple[str, str]]]] = []
    for page in reader.pages:
        runs: list[tuple[str, str]] = []

        def visit(run: str, _cm: list, _tm: list, font: dict | None, _size: float, runs: list = runs) -> None:
            runs.append((str((font or {}).get("/BaseFont", "")).lstrip("/"), run.strip()))

        try:
            page.extract_text(visitor_text=visit)
            pages.append((page.extract_text(extraction_mode="layout"), runs))
        except Exception as e:  # noqa: BLE001  other pages go on
            pages.append((e, []))
    return pages, {str(k).lstrip("/"): str(v) for k, v in (reader.metadata or {}).items()}

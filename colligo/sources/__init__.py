"""Sources: what the catalog can read, by namespace."""

from __future__ import annotations

from colligo.catalog import Catalog


def register_all(catalog: Catalog, root: str | None = None) -> Catalog:
    """All built-in sources, at a root if one is given; nothing is read before it is asked for."""
    from colligo.sources import code, filesystem, json_source, markdown, projects, text, typespec

    for language in ("csharp", "python", "javascript"):
        catalog.register_source(language, code.source_for(language), code.NAMES, root)
    catalog.register_source("text", text.source, ("Files", "Lines", "Regions"), root)
    catalog.register_source("markdown", markdown.source, ("Headings", "Links", "Sections", "FenceBlocks"), root)
    catalog.register_source("filesystem", filesystem.source, ("Folders", "DiskFiles"), root)
    catalog.register_source("projects", projects.source, ("Projects",), root)
    catalog.register_source("typespec", typespec.source, tuple(typespec.SCHEMAS), root)
    catalog.register_source("typespec-http", typespec.http_source, ("Operations", "Services"), root)
    for prefix in ("Code", "Disk", "Markdown"):
        catalog.register_aggregate(prefix)
    for extension, reader in json_source.READERS.items():
        catalog.register_reader(extension, reader)
    return catalog

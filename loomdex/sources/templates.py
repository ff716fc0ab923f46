"""Presets of a scan by kind of project: extensions to take, folders and name patterns to leave out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from .files import keep


@dataclass(frozen=True)
class Template:
    extensions: tuple[str, ...]
    excluded_dirs: tuple[str, ...]
    excluded_names: tuple[str, ...] = ()


def _template(extensions: str, excluded_dirs: str, excluded_names: str = "") -> Template:
    return Template(tuple(extensions.split()), tuple(excluded_dirs.split()), tuple(excluded_names.split()))


# The presets that come with the package; more are given to ``template``.
TEMPLATES = {
    "dotnet": _template(
        ".cs .razor .cshtml .xaml .csproj .props .targets .config .json .xml .yml .yaml .md .scss .css .html .htm .editorconfig",
        "bin obj .vs .git .idea node_modules .next TestResults packages artifacts",
        "*.feature.cs *Steps.g.cs *.AssemblyHooks.cs *.g.cs *.g.i.cs *.Designer.cs *.designer.cs *_i.c *.generated.cs TemporaryGeneratedFile_*.cs *.Cache.cs *.cache *.baml ServiceReference.cs Reference.cs "
        "AssemblyInfo.cs *.xsd.cs *.resx *.resources launchSettings.json packages.lock.json bundleconfig.json *.min.js *.min.css *.map package-lock.json yarn.lock",
    ),
    "python": _template(".py .pyc .pyd .pyo .pyw .pyx .pxd .pxi .ipynb .req .txt", "__pycache__ .venv venv env .tox dist build .git .pytest_cache"),
    "javascript": _template(".js .jsx .json .ts .tsx .html .css .scss .less .mjs", "node_modules dist build coverage .next .nuxt .git"),
    "typescript": _template(".ts .tsx .js .jsx .json .html .css .scss .less", "node_modules dist build coverage .next .nuxt .git"),
    "go": _template(".go .mod .sum", "vendor bin .git"),
    "rust": _template(".rs .toml .lock", "target .cargo .git"),
    "java": _template(".java .gradle .xml .properties .jar .jsp .jspx .class", "build target .gradle .mvn node_modules .git"),
    "generic": _template(".txt .md .json .xml .yaml .yml", ".git .svn .hg node_modules .vscode .idea"),
}


def template(name: str, more: dict[str, Template] | None = None) -> Template:
    """The preset of a name in any case; the generic one for an unknown name."""
    known = TEMPLATES | {k.lower(): v for k, v in (more or {}).items()}
    return known.get(name.lower(), known["generic"])


def chosen(path: Column, name: str, more: dict[str, Template] | None = None) -> Column:
    """Whether the preset takes a path."""
    t = template(name, more)
    return keep(path, extensions=list(t.extensions), excluded_dirs=list(t.excluded_dirs), globs=list(t.excluded_names))

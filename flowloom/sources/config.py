"""Experiment files: a small YAML subset, or PyYAML where it is installed, to dataclasses with typed parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class ModuleConfig:
    name: str
    params: dict[str, str] = field(default_factory=dict)

    def _get(self, key: str) -> str:
        found = {k.lower(): v for k, v in self.params.items()}
        if key.lower() not in found:
            raise KeyError(f"{self.name}: no parameter {key}")
        return found[key.lower()]

    def number(self, key: str) -> int:
        """Decimal, 0x hexadecimal or 0 octal."""
        text = self._get(key).strip().lower()
        return int(text, 16) if text.startswith("0x") else int(text, 8) if len(text) > 1 and text[0] == "0" else int(text)

    def text(self, key: str) -> str:
        return self._get(key)


@dataclass
class Experiment:
    name: str
    ports: dict[int, list[ModuleConfig]]


def _scalar(text: str) -> str:
    text = text.split(" #")[0].strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _parse(lines: list[tuple[int, str]], at: int, depth: int):
    """Maps, lists and scalars by indentation: (value, next line)."""
    if lines[at][1].startswith("- "):
        out: list = []
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
            inner = depth + 2
            lines[at] = (inner, lines[at][1][2:].strip())
            value, at = _parse(lines, at, inner)
            out.append(value)
        return out, at
    made: dict = {}
    while at < len(lines) and lines[at][0] == depth:
        key, _, rest = lines[at][1].partition(":")
        at += 1
        if rest.strip():
            made[key.strip()] = _scalar(rest)
        elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
            made[key.strip()], at = _parse(lines, at, lines[at][0])
        else:
            made[key.strip()] = ""
    return made, at


def load(text: str) -> Experiment:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    tree = _parse(lines, 0, lines[0][0])[0]["Experiment"]
    ports = {int(p["port-id"]): [ModuleConfig(m["name"], {k: v for k, v in m.items() if k != "name"}) for m in p.get("modules") or []] for p in tree.get("ports") or []}
    return Experiment(tree.get("name", ""), ports)


def explain(experiment: Experiment) -> str:
    out = [f"Experiment {experiment.name}"]
    for port, modules in experiment.ports.items():
        out += [f"  port {port}", *(f"    {m.name} {m.params}" for m in modules)]
    return "\n".join(out)

"""Registry files: a corpus's name, home, properties and attribute declarations as plain text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessella.functions.identifiers import is_valid


class RegistryError(ValueError):
    pass


@dataclass
class Entry:
    id: str = ""
    name: str = ""
    home: str = ""
    info: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    attributes: list[str] = field(default_factory=list)
    structures: list[str] = field(default_factory=list)
    aligned: list[str] = field(default_factory=list)
    dynamic: dict[str, str] = field(default_factory=dict)

    def write(self) -> str:
        lines = [f'NAME "{self.name}"', f"ID {self.id}", f"HOME {self.home}", *([f"INFO {self.info}"] if self.info else [])]
        lines += [f'##:: {k} = "{v}"' for k, v in self.properties.items()]
        for word, names in (("ATTRIBUTE", self.attributes), ("STRUCTURE", self.structures), ("ALIGNED", self.aligned)):
            lines += [f"{word} {n}" for n in names]
        return "\n".join(lines + [f'DYNAMIC {n} "{c}"' for n, c in self.dynamic.items()]) + "\n"


def read(text: str) -> Entry:
    """Reads an entry; comments begin with ``#`` except properties (``##:: name = "value"``)."""
    out = Entry()
    lists = {"ATTRIBUTE": out.attributes, "STRUCTURE": out.structures, "ALIGNED": out.aligned}
    for number, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if m := re.fullmatch(r"##::\s*(\w+)\s*=\s*[\"']?(.*?)[\"']?", line):
            out.properties[m[1]] = m[2]
            continue
        line = re.sub(r"\s*#.*", "", line)
        if not line:
            continue
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        bare = rest.strip("\"'")
        if word in ("NAME", "ID", "HOME", "INFO"):
            setattr(out, word.lower(), bare)
        elif word in lists:
            if not is_valid(bare.split()[0]):
                raise RegistryError(f"line {number}: {bare!r} is no name")
            lists[word].append(bare.split()[0])
        elif word == "DYNAMIC":
            name, _, command = rest.partition(" ")
            out.dynamic[name] = command.strip().strip("\"'")
        else:
            raise RegistryError(f"line {number}: unknown declaration {word}")
    if not out.id:
        raise RegistryError("ID is missing")
    return out

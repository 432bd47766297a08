"""A corpus of small source files from eight forms, always the same for a seed."""

import os
import random

FORMS = (
    lambda i, n: (f"Screen{i}.tsx", f"import {{ Glyph }} from 'glyph-kit';\nexport const S{i} = () => <Glyph name='{n()}' size={{24}} />;\n", 1),
    lambda i, n: (f"menu{i}.ts", f"export const MENU_{i} = [{{ label: 'Tea', iconName: '{n()}' }}, {{ label: 'Soup', iconName: \"{n()}\" }}];\n", 2),
    lambda i, n: (f"types{i}.ts", f"export type Names{i} = {' | '.join(repr(n()) for _ in range(40))};\n", 0),
    lambda i, n: (f"util{i}.ts", f"export function f{i}(x: number): number {{ const label = 'Good Day'; return x * {i}; }}\n", 0),
    lambda i, n: (f"Toggle{i}.tsx", f"export const T{i} = ({{ on }}: {{ on: boolean }}) => <Icon name={{on ? '{n()}' : '{n()}'}} />;\n", 2),
    lambda i, n: (f"tpl{i}.ts", "export const k = `${a ? '" + n() + "' : '" + n() + "'}`;\n", 2),
    lambda i, n: (f"plain{i}.ts", f"export const STYLES_{i} = {{ padding: 8, color: 'Red' }};\n", 0),
    lambda i, n: (f"plain{i}.js", f"// 'home' in a comment\nmodule.exports = {{ name: '{n()}', n: {i} }};\n", 1),
)


def files(total: int, names: list[str], seed: int = 7):
    """(relative path, code, names it uses as values)."""
    rng = random.Random(seed)
    for i in range(total):
        used: list[str] = []

        def name():
            used.append(rng.choice(names))
            return used[-1]

        file, code, values = FORMS[i % len(FORMS)](i, name)
        yield f"pkg{i % 40}/feature{i % 300}/{'lib' if i % 5 == 0 else 'ui'}/{file}", code, set(used) if values else set()


def write(root: str, total: int, names: list[str], seed: int = 7) -> dict[str, set[str]]:
    out = {}
    for path, code, used in files(total, names, seed):
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(code)
        out[full] = used
    return out

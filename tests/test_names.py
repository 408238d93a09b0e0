"""Every global name that a function of the library reads exists, also those that no test reaches."""

import builtins
import dis
import importlib
import pkgutil
import types

import linework


def globals_read(code: types.CodeType) -> set[str]:
    own = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
    return own.union(*(globals_read(c) for c in code.co_consts if isinstance(c, types.CodeType)))


def test_names_exist():
    missing = set()
    for m in pkgutil.walk_packages(linework.__path__, "linework."):
        module = importlib.import_module(m.name)
        for f in vars(module).values():
            if isinstance(f, types.FunctionType) and f.__module__ == m.name:
                missing |= {(m.name, n) for n in globals_read(f.__code__) if not hasattr(module, n) and not hasattr(builtins, n)}
    assert not missing

"""Sources: tables whose rows carry the atom they belong to and their place in the stream.

Every source adds ``__atom`` (ordinal of the atomic batch), ``__seq`` (place in the stream, from 0) and ``__key``
(the contextual key, the value itself unless given).
"""

from atomflow.sources.batch import ATOM, KEY, META, SEQ, empty, from_list, from_lists, from_range, signal, with_atoms
from atomflow.sources.generated import AtomFiles, GeneratorSource, generator, throttled

__all__ = ["ATOM", "KEY", "META", "SEQ", "AtomFiles", "GeneratorSource", "empty", "from_list", "from_lists", "from_range", "generator", "signal", "throttled", "with_atoms"]

"""What a Python worker keeps from task to task, so that tables made once serve all tasks of that worker."""

from __future__ import annotations

from collections import OrderedDict

_KEPT: OrderedDict = OrderedDict()


def kept(key, make, room: int = 16):
    """The object with this key, made where this worker lacks it; of all objects the `room` last used ones stay."""
    if key not in _KEPT:
        _KEPT[key] = make()
    _KEPT.move_to_end(key)
    while len(_KEPT) > room:
        _KEPT.popitem(last=False)
    return _KEPT[key]

"""How long steps take, as log lines of ``glossa``."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

LOG = logging.getLogger("glossa")


def timed(step: Callable) -> Callable:
    """Logs the name of a call and the seconds that it took. Lazy plans are timed as such: what they run when read is the reader's time."""

    @functools.wraps(step)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return step(*args, **kwargs)
        finally:
            LOG.info("%s.%s: %.3f s", step.__module__, step.__qualname__, time.perf_counter() - began)

    return run

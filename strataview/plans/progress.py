"""Progress of a run: records read so far, reported at an interval while tasks end."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from strataview.functions.text import sigfig, speed, timediff

Report = Callable[[int, float], None]


def status_line(records: int, seconds: float) -> None:
    print(f"{sigfig(records)} records in {timediff(seconds)}, {speed(seconds, records)} records/s", flush=True)


class Progress:
    """Calls ``report(records, seconds)`` every ``interval`` seconds and once at the end; ``count`` is an accumulator."""

    def __init__(self, count, interval: float, report: Report = status_line):
        self.count, self.interval, self.report = count, interval, report
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._over.wait(self.interval):
            self._tell()

    def _tell(self) -> None:
        self.report(self.count.value, time.monotonic() - self._began)

    def __enter__(self) -> Progress:
        self._began = time.monotonic()
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self._tell()

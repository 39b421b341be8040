"""Noticing changes of a source tree and rebuilding, one rebuild at a time."""

from __future__ import annotations

import ctypes
import errno
import os
import select
import sys
import threading
from collections.abc import Callable

from lodestone.sources.tree import DEFAULT_IGNORE, open_root, walk

QUIET_MS = 300


class Debouncer:
    """Runs ``flush`` once triggers have been quiet for a while. Runs never overlap; triggers that come during one
    bring exactly one more after it."""

    def __init__(self, quiet_ms: float, flush: Callable[[], None], on_error: Callable[[Exception], None] = lambda error: None):
        self.quiet, self.flush, self.on_error = quiet_ms / 1000, flush, on_error
        self._lock, self._timer, self._running, self._again = threading.Lock(), None, False, False

    def trigger(self) -> None:
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
            self._timer = threading.Timer(self.quiet, self._run)
            self._timer.daemon = True
            self._timer.start()

    def cancel(self) -> None:
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()

    def _run(self) -> None:
        with self._lock:
            if self._running:
                self._again = True
                return
            self._running = True
        try:
            self.flush()
        except Exception as error:
            self.on_error(error)
        with self._lock:
            self._running, again, self._again = False, self._again, False
        if again:
            self.trigger()


class FolderEvents:
    """The kernel's notices (inotify) of what happens in a local tree, but for ignored folders. OSError where there are none."""

    #: Fixed values of the interface: written and closed, attributes, moved from and to, created, deleted; flags of the handle.
    _MASK, _FLAGS = 0x8 | 0x4 | 0x40 | 0x80 | 0x100 | 0x200, 0o2000000 | 0o4000

    def __init__(self, folder: str, ignore):
        if "://" in folder or not sys.platform.startswith("linux"):
            raise OSError("no notices for this folder")
        self._libc = ctypes.CDLL(None, use_errno=True)
        self.folder, self.ignore = os.path.abspath(folder), set(ignore)
        self._handle = self._call(self._libc.inotify_init1, self._FLAGS)
        try:
            self._watch()
        except OSError:
            self.close()
            raise

    @staticmethod
    def _call(function, *given) -> int:
        if (found := function(*given)) < 0:
            raise OSError(ctypes.get_errno(), "inotify")
        return found

    def _watch(self) -> None:
        for place, folders, _ in os.walk(self.folder):
            folders[:] = [f for f in folders if f not in self.ignore]
            try:
                self._call(self._libc.inotify_add_watch, self._handle, os.fsencode(place), self._MASK)
            except OSError as error:
                if error.errno != errno.ENOENT:  # gone meanwhile, which is no trouble; too many to watch is
                    raise

    def wait(self, seconds: float) -> bool:
        """Whether something happened within that time; folders that came are watched from then on."""
        if not select.select([self._handle], [], [], seconds)[0]:
            return False
        try:
            while os.read(self._handle, 1 << 16):
                pass
        except BlockingIOError:
            pass
        self._watch()
        return True

    def close(self) -> None:
        os.close(self._handle)


class Watcher:
    """Triggers a debounced flush when files of a tree come, go or change.

    The tree is listed when the kernel tells of a change in it; where it can't (another file system, more folders than
    may be watched), every ``poll_ms``.
    """

    def __init__(self, folder: str, flush: Callable[[], None], ignore=(), quiet_ms: float = QUIET_MS, poll_ms: float = 200, on_error: Callable[[Exception], None] = lambda error: None):
        self._options = {"ignore": [*DEFAULT_IGNORE, *ignore], "replace_ignore": True}
        self.folder, self._poll, self._closed = folder, poll_ms / 1000, threading.Event()
        self._debouncer, self.events = Debouncer(quiet_ms, flush, on_error), None
        try:
            open_root(folder)
            try:
                self.events = FolderEvents(folder, self._options["ignore"])
            except (OSError, AttributeError):
                pass
            self._last = list(walk(folder, **self._options))
            self.started = True
        except Exception as error:
            self.started = False
            on_error(error)
            return
        threading.Thread(target=self._look, daemon=True).start()

    def _changed(self) -> bool:
        """Whether it is time to list the tree."""
        if self.events is None:
            return not self._closed.wait(self._poll)
        try:
            return self.events.wait(self._poll)
        except OSError:
            self.events.close()
            self.events = None
            return True

    def _look(self) -> None:
        while not self._closed.is_set():
            if not self._changed():
                continue
            try:
                now = list(walk(self.folder, **self._options))
            except Exception:
                continue  # a folder may go while it is listed
            if now != self._last:
                self._last = now
                self._debouncer.trigger()
        if self.events is not None:
            self.events.close()

    def close(self) -> None:
        self._closed.set()
        self._debouncer.cancel()


class Served:
    """Holds the graph that queries see now; a rebuild replaces it at once."""

    def __init__(self, graph):
        self._graph = graph

    def __call__(self):
        return self._graph

    def swap(self, graph) -> None:
        self._graph = graph

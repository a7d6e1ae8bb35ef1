"""Lost tasks: every sample once, no leftovers."""

import os
import subprocess
import sys


def test_lost_attempts_change_nothing():
    job = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_job.py")
    done = subprocess.run([sys.executable, job], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "tarshards whole" in done.stdout and "mds whole" in done.stdout and "writer whole" in done.stdout

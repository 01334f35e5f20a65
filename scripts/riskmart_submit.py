"""Launcher for spark-submit (which runs a file, not ``-m``): forwards to ``riskmart.__main__``."""

import sys

from riskmart.__main__ import main

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

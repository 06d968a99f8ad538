"""python -m ferrule: see ferrule.repl."""

import sys

from ferrule.repl import main

main(sys.argv[1:])

import sys

from corpusflow.cli import main

sys.exit(main())

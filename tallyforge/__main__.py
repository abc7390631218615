"""Command line entry."""

from .cli import main

raise SystemExit(main())

"""``python -m tidemill resolve <tenant.json>``: what a tenant's settings resolve to."""

from __future__ import annotations

import sys
from pathlib import Path

from tidemill.config import Tenant
from tidemill.sources.strategies import pick


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "resolve":
        print(__doc__)
        return 2
    t = Tenant.from_json(Path(args[1]).read_text())
    print(f"customer={t.customer_id} storage={t.storage_type} delta_strategy={pick(t)[0]}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

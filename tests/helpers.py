"""Small shared fixtures."""


def rows(df, *columns, sort=True):
    picked = df.select(*columns) if columns else df
    out = [tuple(r) for r in picked.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (list, dict)) else (False, "", str(x)) for x in r)) if sort else out


LONG = "x" * 200


def verdict(task_id, qa="yes", reason=LONG, version="v1", **extra):
    return {"task_id": task_id, "qa": qa, "reason": reason, "schema_version": version, **extra}

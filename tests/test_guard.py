import pytest

from rookery import errors, guard

POLICY = {"tenants": {"a": {"allowed_roots": ["/srv/a"]}, "b": {"allowed_roots": ["/srv"], "allowed_path_prefixes": ["src", "lib/x/"]}, "c": {"allowed_roots": []}, "d": {"allowed_roots": ["/"], "allowed_path_prefixes": ["*"]}, "e": {"allowed_roots": ["/"], "allowed_path_prefixes": ["../x"]}}}


@pytest.mark.parametrize(
    "tenant, root, paths, error",
    [
        ("a", "/srv/a/r", None, None), ("a", "/srv/ab", None, errors.Forbidden), ("a", "/srv/a/../b", None, errors.Forbidden), (None, "/srv/a", None, errors.InvalidRequest), (" ", "/srv/a", None, errors.InvalidRequest),
        ("x", "/srv/a", None, errors.Forbidden), ("c", "/srv", None, errors.Forbidden), ("a", "/srv/a", ["../x"], errors.InvalidRequest), ("a", "/srv/a", "src", errors.InvalidRequest),
        ("b", "/srv/r", None, errors.Forbidden), ("b", "/srv/r", ["src/a.py", "./lib/x"], None), ("b", "/srv/r", ["src2/a.py"], errors.Forbidden), ("b", "/srv/r", ["/etc"], errors.InvalidRequest),
        ("d", "/any", ["x/y"], None), ("d", "/any", [], errors.Forbidden), ("e", "/any", ["x"], errors.Forbidden),
    ],
)
def test_policy(tenant, root, paths, error):
    if error is None:
        guard.authorize(POLICY, tenant, root, paths)
    else:
        with pytest.raises(error):
            guard.authorize(POLICY, tenant, root, paths)


def test_policies_from_files(tmp_path):
    (tmp_path / "p.edn").write_text('{:tenants {:a {:allowed_roots ["/srv/a"]}}}')
    (tmp_path / "p.json").write_text('{"tenants": {"a": {"allowed_roots": ["/srv/a"]}}}')
    assert guard.load(str(tmp_path / "p.edn")) == guard.load(str(tmp_path / "p.json"))
    guard.authorize(None, None, "/x")

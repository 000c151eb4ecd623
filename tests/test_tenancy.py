from pactframe.operators import tenancy
from tests.conftest import rows

MEMBERS = [("u1", "a1", "owner"), ("u1", "a2", "viewer"), ("u2", "a2", "member"), ("u3", "a3", "admin"), ("u1", "a1", "owner")]
DDL = "user_id string, account_id string, role string"


def test_scope_of_a_user_with_two_accounts(frame):
    members = frame(MEMBERS, DDL)
    mine = tenancy.my_accounts(members, "u1")
    assert rows(mine, "account_id") == [("a1",), ("a2",)]
    data = frame([(1, "a1"), (2, "a2"), (3, "a3"), (4, None)], "id int, account_id string")
    # the repeated membership doubles nothing, and a row without account belongs to nobody
    assert rows(tenancy.in_scope(data, mine).select("id"), "id") == [(1,), (2,)]
    assert tenancy.in_scope(data, tenancy.my_accounts(members, "nobody")).count() == 0


def test_global_packs_are_visible_to_all(frame):
    packs = frame([(1, None), (2, "a1"), (3, "a3")], "id int, account_id string")
    mine = tenancy.my_accounts(frame(MEMBERS, DDL), "u1")
    assert rows(tenancy.own_or_global(packs, mine).select("id"), "id") == [(1,), (2,)]
    nobody = tenancy.my_accounts(frame(MEMBERS, DDL), "nobody")
    assert rows(tenancy.own_or_global(packs, nobody).select("id"), "id") == [(1,)]


def test_profiles_of_colleagues_and_self(frame):
    profiles = frame([("u1", "x"), ("u2", "y"), ("u3", "z"), ("u4", "w")], "id string, email string")
    members = frame(MEMBERS, DDL)
    assert rows(tenancy.visible_profiles(members, profiles, "u2").select("id"), "id") == [("u1",), ("u2",)]
    assert rows(tenancy.visible_profiles(members, profiles, "u4").select("id"), "id") == [("u4",)]


def test_permissions_by_role(frame):
    members = frame([(r, "a", r) for r in ("owner", "admin", "member", "viewer")], DDL)
    asked = frame([(r, "a") for r in ("owner", "admin", "member", "viewer", "none")], "user_id string, account_id string")
    found = {r.user_id: (r.can_edit, r.can_admin) for r in tenancy.member_permissions(asked, members).collect()}
    assert found == {
        "owner": (True, True), "admin": (True, True), "member": (True, False), "viewer": (False, False), "none": (False, False)
    }


def test_action_matrix(frame):
    members = frame([(r, "a", r) for r in ("owner", "member", "viewer")], DDL)
    contracts = frame([("c1", "a")], "id string, account_id string")
    asked = frame(
        [(u, c, a) for u in ("owner", "member", "viewer", "none") for c in ("c1",) for a in ("read", "insert", "update", "delete")]
        + [("owner", "gone", "read"), ("owner", "c1", "burn")],
        "user_id string, contract_id string, action string",
    )
    allowed = {(r.user_id, r.contract_id, r.action) for r in tenancy.contract_access_decisions(asked, contracts, members).collect() if r.allowed}
    assert allowed == {
        *(("owner", "c1", a) for a in ("read", "insert", "update", "delete")),
        *(("member", "c1", a) for a in ("read", "insert", "update")),
        ("viewer", "c1", "read"),
    }

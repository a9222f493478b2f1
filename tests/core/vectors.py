"""Record inputs and the HMACs they must give, under the published test key and session."""

SECRET, SESSION = bytes(range(32)), bytes.fromhex("00112233445566778899aabbccddeeff")
KEY_ID = "e528e95798037df410543d9f31e396ecdd458d71b157d6014398bae32fb56c65"

#: (event, payload) of the seven inputs, one second apart from 2026-05-10T12:00:00.000Z, actor user:david.
INPUTS = [
    ("vault.unlocked", {"vault_id": "v-001"}),
    ("shield.classified", {"decision": "allow", "rule": "r-12"}),
    ("shield.classified", {"decision": "deny", "rule": "r-7"}),
    ("shield.classified", {"decision": "allow", "rule": "r-12"}),
    ("shield.classified", {"decision": "allow", "rule": "r-3"}),
    ("shield.classified", {"decision": "deny", "rule": "r-9"}),
    ("vault.locked", {"vault_id": "v-001"}),
]

#: With segments of 1,024 bytes: segment, record_id, payload length, HMAC.
ROLLOVER = [
    (0, 0, 167, "470d5142d63eee765aae496780fb8293b27a5346c687231d0ecc3b38452522c2"),
    (0, 1, 182, "adc192201e3bd519cc9c3e1ab9247fba098850f817de539098c015427eb5ca8f"),
    (0, 2, 180, "3bf942484631bd02c19d74ebf131e668b6eaf0e1d3e6ab98eaf93d73f80a4fdd"),
    (0, 3, 213, "1c76278b3db82399405689748333cf9c3273361f234c707c0f94af039bead44b"),
    (1, 0, 182, "ba8e9b968924858ba8e21ddadf51093ca2834374c63575a4f60c8d62b4b691b4"),
    (1, 1, 181, "424a71a548df12b05d019743871a88940fdcd03718766ef6ecf78ca25e0e3b69"),
    (1, 2, 180, "c8d8616f4cb256fb1cb5204ada42b8550a37c017e63c2df9bbcf97cc04f5ac74"),
    (1, 3, 213, "db67d363b0a047962842efe804159e332dd79c959e6fcaa8157052a49e34f22f"),
    (2, 0, 167, "ae118dc9ae426e01b37f8a350b2611716e036863c965657e5e8f4e08f64b26c5"),
]
CHAIN_START = "48802fa044ab1dfd48d97b582ad1ddbe5fe68a5183a120cbdfd849d51aca358c"
FILE_BYTES = [982, 996, 287]

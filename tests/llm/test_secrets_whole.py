"""Ordinary identifiers with digits are no secrets; keys without digits are."""

import random
import string

import numpy as np
import pytest

from tickloom.llm import secrets
from tickloom.llm.common import table

ORDINARY = ["release-candidate-2024-11-27", "articles/2024/11/27/summer-in-paris", "chapter1/section2/figure3", "sha256_of_normalized_text", "training-data-pipeline-2024", "-" * 40, "=" * 30, "_" * 24, "31415926535897932384626433"]


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(table(spark, "/root/testdata/sf0.01", "documents"))


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary_identifiers_are_no_finds(model, text):
    assert secrets.markov_finds(f"see {text} there", model, []) == []


#: Names of code written for this test; no sample holds them.
NAMES = """
XMLHttpRequestEventTargetFactoryBean GL_TEXTURE_CUBE_MAP_POSITIVE_X CONFIG_DEBUG_INFO_BTF_MODULES x86_64-unknown-linux-gnu-gcc
ACGTACGTACGTACGTACGTACGT AAAAAAAAAAAAAAAAAAAAAAAA HTTP_STATUS_INTERNAL_SERVER_ERROR getElementsByTagNameNS_internal
aarch64-apple-darwin20-clang MAX_CONCURRENT_STREAM_COUNT onUserAuthenticationRequestCompleted test_parse_json_with_trailing_comma
usr/local/lib/python3/site-packages SQLITE_ENABLE_COLUMN_METADATA NSURLSessionConfigurationDelegate WM_NOTIFY_PARENT_WINDOW_CHANGED
java/util/concurrent/ConcurrentHashMap EXT_texture_filter_anisotropic libstdc++-devel-static-x86_64 BUILD_SHARED_LIBS_DEFAULT_ON
AbstractSingletonProxyFactoryBean 123e4567-e89b-12d3-a456-426614174000 550E8400-E29B-41D4-A716-446655440000 GATTACAGATTACAGATTACACCAT
VK_FORMAT_R8G8B8A8_UNORM_PACK vkGetPhysicalDeviceSurfaceSupport ERR_CERT_AUTHORITY_INVALID_NAME CreateOrUpdateSubscriptionRequest
spring-boot-starter-data-jpa-2 PYTHON_EXECUTABLE_SEARCH_PATH com/google/common/collect/ImmutableList UITableViewControllerDataSource
net_ipv4_tcp_congestion_control SELECT_CUSTOMER_ORDER_HISTORY rollback_transaction_on_failure AWSElasticLoadBalancerListener
""".split()


def test_precision_and_recall_on_labelled_names_and_keys(model):
    """36 names, 36 keys. Four names were taken for keys when this was written (two of OpenGL and Vulkan in upper case, two long
    ones in camel case) and no key was missed; it must not get worse than one more of each."""
    draw = random.Random(77)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits)
    keys = ["".join(draw.choices(alphabets[i % 4], k=draw.randint(20, 31))) for i in range(len(NAMES))]
    found = lambda s: bool(secrets.markov_finds(f"see {s} there", model, []))
    hits, false = sum(map(found, keys)), [n for n in NAMES if found(n)]
    assert len(false) <= 5, false
    assert hits >= len(keys) - 1


def test_runs_are_sampled_from_all_of_a_text():
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    taken = [r for r in secrets.identifiers(" ".join(words), 100) if r in set(words)]
    assert len(taken) == 100 and taken == sorted(taken, key=words.index)
    assert any(w in taken for w in words[-100:])


def test_random_keys_with_and_without_digits_are_finds(model):
    draw = random.Random(12)
    for alphabet in (string.ascii_letters, string.ascii_letters + string.digits):
        keys = ["".join(draw.choices(alphabet, k=20)) for _ in range(500)]
        assert np.mean([bool(secrets.markov_finds(k, model, [])) for k in keys]) >= 0.99
